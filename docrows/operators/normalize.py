"""Normalization of records: headers, and each cell by its field's name and its content. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import looks_like_date, normal_date
from ..functions.headers import normal_header
from ..functions.lexicon import DATE_FORMATS
from ..functions.numbers import looks_like_number, to_number
from ..functions.text import compose, let, normal_text, strip
from .model import as_map, number_cell, text_cell


def value_cell(value: Column, field: Column, formats: tuple[str, ...] = DATE_FORMATS, out: str = "yyyy-MM-dd", guess: bool = True) -> Column:
    """Cell of a composed text: a date by the known formats or, with ``guess``, of a free form, a number, or text; blank is null."""

    def typed(v: Column) -> Column:
        plain = F.when(looks_like_date(v, field), let(normal_date(v, formats, out, guess), text_cell)).when(looks_like_number(v, field), let(to_number(v), number_cell))
        return F.when(v == "", text_cell(F.lit(None))).otherwise(plain.otherwise(let(normal_text(v, nfc=False), text_cell)))

    return let(strip(value), typed)


def normal_entries(entries: Column | str, formats: tuple[str, ...] = DATE_FORMATS, out: str = "yyyy-MM-dd", guess: bool = True, nfc: bool = True, lower: bool = True) -> Column:
    """Entries with normal headers and values; of headers that become equal the last value counts, at the first place."""
    composed = compose if nfc else lambda c: c
    named = F.transform(entries, lambda e: F.struct(normal_header(composed(e["k"]), lower).alias("k"), e["v"].alias("v")))
    cell = lambda e: F.when(e["v"]["t"] == "s", value_cell(composed(e["v"]["s"]), e["k"], formats, out, guess)).otherwise(e["v"])
    return let(F.transform(named, lambda e: F.struct(e["k"].alias("k"), cell(e).alias("v"))), as_map)


def normalize(records: DataFrame, formats: tuple[str, ...] = DATE_FORMATS, out: str = "yyyy-MM-dd", guess: bool = True, nfc: bool = True, lower: bool = True) -> DataFrame:
    """Normalize all records, in one projection; nothing is shuffled. ``guess``: dates of free forms too; ``nfc``: texts and headers are composed first."""
    return records.withColumn("entries", normal_entries("entries", formats if out in formats else (*formats, out), out, guess, nfc, lower))
