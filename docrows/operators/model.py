"""Shapes of documents and records.

A record's fields vary by row, and their order counts, so a record is an array of named cells. A cell is a text (``s``), a
number (``n``), a truth value (``b``, as text) or nested JSON (``j``, as text); a null cell has kind null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

CELL = "struct<t:string,s:string,n:double>"
ENTRIES = f"array<struct<k:string,v:{CELL}>>"
DOCUMENT = "path string, file_name string, file_ord int, text string, tables array<array<array<string>>>, extraction_method string"
RECORD = f"file_ord int, rec_ord int, source_file string, doc_type string, entries {ENTRIES}"


def text_cell(c: Column) -> Column:
    return F.struct(F.when(c.isNotNull(), "s").alias("t"), c.cast("string").alias("s"), F.lit(None).cast("double").alias("n"))


def number_cell(c: Column) -> Column:
    return F.struct(F.when(c.isNotNull(), "n").alias("t"), F.lit(None).cast("string").alias("s"), c.cast("double").alias("n"))


def json_cell(c: Column) -> Column:
    return F.struct(F.when(c.isNotNull(), "j").alias("t"), c.cast("string").alias("s"), F.lit(None).cast("double").alias("n"))


def entry(k: Column | str, v: Column) -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.alias("v"))


def as_map(pairs: Column) -> Column:
    """Of entries with the same name, the last one's value at the first one's place."""

    def merged(pairs: Column) -> Column:
        first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
        last = lambda p: F.element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), -1)["v"]
        own = F.size(F.array_distinct(F.transform(pairs, lambda p: p["k"]))) == F.size(pairs)
        return F.when(own, pairs).otherwise(F.transform(first, lambda p: F.struct(p["k"].alias("k"), last(p).alias("v"))))

    return let(pairs, merged)


def cell(entries: Column | str, name: str) -> Column:
    """The cell of that name, or null where the record lacks it."""
    return F.get(F.filter(entries, lambda e: e["k"] == name), F.lit(0))["v"]


def public(entries: Column | str) -> Column:
    """Entries that are not internal, which begin with ``_``."""
    return F.filter(entries, lambda e: ~F.startswith(e["k"], F.lit("_")))
