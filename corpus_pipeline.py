"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next.

Toxic documents go, repeated lines go, one document of each group of near duplicates stays,
documents that hold benchmark items go, and what is left is packed into training windows.

Defined cases, the same in every stage: a row without doc_id is judged for toxicity by its text, is otherwise kept as it is and
gets no window; null and empty texts are kept until packing, where they have no tokens and so no window; rows that repeat
a doc_id with the same text are one document (line and near deduplication keep or drop them alike), with another
text they are judged by it; empty tables of any kind give empty results; columns besides doc_id and text pass through the
first four stages, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, line_dedup, minhash_dedup, packing, toxicity
from foliospark.llm.shared import load, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text scores as toxic."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that an earlier line equals or nearly equals; documents of which nothing is left go."""
    return line_dedup.dedup_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near duplicates."""
    return minhash_dedup.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, edited or not."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(window_id, doc_id, segment, start_token, n_tokens): where every token of docs goes."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("near dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack_windows),
]

# The character lattice, the deletion neighbourhood, alignment and segment tree are not SQL's to state.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
