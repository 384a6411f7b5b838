"""Session helpers of the subpackage: input tables, tables written to cut lineage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where the session names none, a local session (one machine, as in tests)
    gets one of its own; on a cluster, whose executors wouldn't share it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='foliospark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliospark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = _path(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df, written once to the shared folder and read again: lineage ends there,
    and a lost executor costs no recomputation of what came before.  The files go when the application ends."""
    return _write(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of `_write` that nothing reads any more."""
    files, p = _path(spark, path)
    files.delete(p, True)


def output_schema(df: DataFrame, keep: list[str], extra: str) -> T.StructType:
    """Fields `keep` of df, with their own types, followed by the fields of a DDL string."""
    fields = [T.StructField(c, df.schema[c].dataType, True) for c in keep]
    return T.StructType(fields + list(T.StructType.fromDDL(extra).fields))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an undirected edge list; the label is the least node of its component.

    Large-star / small-star contraction: each round is two grouped minima, so no node's whole
    neighbourhood is held in one place, and the number of rounds is logarithmic in the diameter.
    Raises if `rounds` of them don't end it, which takes a diameter beyond 2^`rounds` / 2.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, path = _write(e, "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(least.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        e, path = _write(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(spark, old)
        several = e.groupBy("u").count().where("count > 1").select("u")
        chained = e.join(e.select(F.col("v").alias("x")), F.col("u") == F.col("x"), "left_semi").select("u")
        if several.unionByName(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    labels = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = labels.select(F.col("label").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return labels.unionByName(roots)


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with each doc_id once: of rows that repeat a doc_id the least text counts; rows
    without doc_id or text are left out.  Only the texts of repeated ids are shuffled."""
    src = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    twice = written(src.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    least = src.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return src.join(twice, "doc_id", "left_anti").unionByName(least)
