"""Where queries register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(s: str) -> str:
    """A string as SQL has it."""
    return "'" + s.replace("'", "''") + "'"


def replaced(expr: str, pairs: list[tuple[str, str]]) -> str:
    """Literal replacements, one after the other, as SQL."""
    for a, b in pairs:
        expr = f"replace({expr}, {literal(a)}, {literal(b)})".replace("'\n'", "chr(10)")
    return expr


def regexes(expr: str, *rules: tuple[str, str]) -> str:
    """Regular-expression replacements, one after the other, as SQL; line breaks in replacements as \\n."""
    for a, b in rules:
        to = " || ".join(f"{literal(x)}" for x in b.split("\n")).replace(" || ", " || chr(10) || ") if "\n" in b else literal(b)
        expr = f"regexp_replace({expr}, {literal(a)}, {to}, 'g')"
    return expr


def stripped(expr: str) -> str:
    return regexes(expr, (r"^\s+", ""), (r"\s+$", ""))
