"""Wide tables from records, and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import cell, public


def field_names(records: DataFrame, internal: bool = False) -> DataFrame:
    """name, at: each field's name and the place of its first appearance."""
    e = records.select("file_ord", "rec_ord", F.posexplode(F.col("entries") if internal else public("entries")).alias("pos", "e"))
    return e.groupBy(F.col("e.k").alias("name")).agg(F.min(F.struct("file_ord", "rec_ord", "pos")).alias("at"))


def ordered_names(records: DataFrame, internal: bool = False) -> list[str]:
    """Names of the output's columns, by first appearance. There are as many as the output has columns."""
    return [r["name"] for r in field_names(records, internal).orderBy("at").collect()]


def shown_number(n: Column) -> Column:
    """A double as shortest decimal text with at least one decimal; very large and very small ones have two decimals."""
    a = F.abs(n)
    whole = F.concat(n.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    small = F.regexp_replace(n.cast("decimal(38,16)").cast("string"), "0+$", "")
    return (
        F.when((a > 1e10) | ((a < 1e-4) & (n != 0)), F.replace(F.format_number(n, 2), F.lit(",")))
        .when((a >= 1e7) & (n == F.floor(n)), whole).when((a >= 1e7) | ((a < 1e-3) & (n != 0)), small).otherwise(n.cast("string"))
    )


def shown(v: Column) -> Column:
    """A cell as text; null is empty."""
    return F.coalesce(F.when(v["t"] == "n", shown_number(v["n"])).otherwise(v["s"]), F.lit(""))


def widen(records: DataFrame, names: list[str] | None = None, internal: bool = False, text: bool = True) -> DataFrame:
    """A column for each field. ``text``: rendered as text; otherwise cells."""
    names = ordered_names(records, internal) if names is None else names
    return records.select("file_ord", "rec_ord", *((shown(cell("entries", n)) if text else cell("entries", n)).alias(n) for n in names))


def run_stats(documents: DataFrame, parsed: DataFrame, output: DataFrame) -> DataFrame:
    """One row: files, files_parsed, rows_parsed, rows_output, duplicates_removed, errors, warnings (files without records)."""
    failed = F.sum(F.col("error").isNotNull().cast("long")) if "error" in documents.columns else F.lit(0).cast("long")
    parts = [
        documents.agg(F.count("*").alias("files"), failed.alias("errors")),
        parsed.agg(F.countDistinct("file_ord").alias("files_parsed"), F.count("*").alias("rows_parsed")),
        output.agg(F.count("*").alias("rows_output")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)  # a row each
    sums = every.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in every.columns))
    return sums.select(
        "files", "files_parsed", "rows_parsed", "rows_output", (F.col("rows_parsed") - F.col("rows_output")).alias("duplicates_removed"),
        "errors", (F.col("files") - F.col("files_parsed") - F.col("errors")).alias("warnings"),
    )


def counts(df: DataFrame, by: str) -> DataFrame:
    """Rows of each kind, the most common first."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def distinct_values(records: DataFrame, name: str, most: int = 20) -> DataFrame:
    """A sample of a field's distinct filled values."""
    value = cell("entries", name)["s"]
    return records.select(value.alias(name)).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct().limit(most)
