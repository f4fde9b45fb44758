"""Invoices: header fields by patterns, items from cell grids or from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import INVOICE_PATTERNS, ITEM_FIELDS, ITEM_PATTERNS
from ..functions.numbers import to_number
from ..functions.tables import item_field, item_header_row
from ..functions.text import clean_text, first_match, let, strip
from .model import entry, json_cell, number_cell, text_cell

ITEM = "struct<quantity:string,description:string,unit_price:string,line_total:string,unit:string>"


def header_fields(text: Column) -> dict[str, Column]:
    """Header fields of a cleaned text; the long date stands in for the short one."""
    found = {k: first_match(text, p, 2 if k == "invoice_id" else 1) for k, p in INVOICE_PATTERNS.items()}
    found["date"] = F.coalesce(found["date"], found.pop("date_long"))
    return {k: found[k] for k in ("invoice_id", "date", "vendor", "client", "tax_id", "subtotal", "tax", "total")}


def items_from_text(text: Column) -> Column:
    """Items of a text: the whole matches first, in one scan, then the parts of each.

    A text without two numbers side by side has none and isn't searched, and no search begins inside a number, where it would end as at its start.
    """
    pattern = f"(?md)(?<![0-9]){ITEM_PATTERNS['full_line']}"
    parts = ("quantity", "description", "unit_price", "line_total")
    item = lambda m: F.struct(*(strip(F.regexp_extract(m, pattern, g)).alias(n) for g, n in enumerate(parts, 1)), F.lit(None).cast("string").alias("unit"))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), item)
    return F.when(~text.rlike("[0-9,.]\\s+\\$?[0-9,.]"), F.array().cast(f"array<{ITEM}>")).otherwise(found)


def short_items(text: Column) -> Column:
    """Lines of a text that end in an amount, as (description, line_total)."""
    pattern = f"(?md)^{ITEM_PATTERNS['simple_line']}"
    item = lambda m: F.struct(*(strip(F.regexp_extract(m, pattern, g)).alias(n) for g, n in enumerate(("description", "line_total"), 1)))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), item)


def items_from_table(table: Column) -> Column:
    """Items below the header row; of columns that claim the same field the last one counts, null or not."""
    def below(at: Column) -> Column:
        rows = F.filter(F.slice(table, at + 2, F.size(table)), lambda r: F.exists(r, lambda c: c.isNotNull() & (c != "")))
        places = F.transform(F.get(table, at), item_field)
        return let(F.array(*(_places(places, f) for f in ITEM_FIELDS)), lambda p: F.filter(F.transform(rows, lambda r: item(r, p)), lambda i: i.isNotNull()))

    def item(r: Column, p: Column) -> Column:  # p: the columns of each field, from 0
        last = lambda k: F.array_max(F.filter(F.get(p, F.lit(k)), lambda c: c < F.size(r)))
        some = F.exists(p, lambda cols: F.exists(cols, lambda c: c < F.size(r)))
        return F.when(some, F.struct(*(let(last(k), lambda c: F.get(r, c)).alias(f) for k, f in enumerate(ITEM_FIELDS))))

    none = F.array().cast(f"array<{ITEM}>")
    return F.when(F.size(table) >= 2, let(item_header_row(table), lambda at: F.when(at.isNotNull(), below(at)).otherwise(none))).otherwise(none)


def _places(fields: Column, name: str) -> Column:
    """Numbers from 0 of the columns that claim a field."""
    return F.filter(F.transform(fields, lambda f, i: F.when(f == name, i)), lambda i: i.isNotNull())


def items_from_tables(tables: Column) -> Column:
    return F.flatten(F.transform(tables, items_from_table))


def with_invoice(docs: DataFrame) -> DataFrame:
    """Adds the header fields, items and items_count; a missing subtotal is the sum of the lines' totals.

    Lines' totals are read as numbers, so that one with thousands separators counts.
    """
    text = clean_text(F.coalesce("text", F.lit("")))
    df = docs.withColumn("__text", text)
    for name, c in header_fields(F.col("__text")).items():
        df = df.withColumn(name, c)
    tables = F.coalesce(F.size("tables"), F.lit(0)) > 0
    df = df.withColumn("items", F.when(tables, items_from_tables(F.col("tables"))).otherwise(items_from_text(F.col("__text"))).cast(f"array<{ITEM}>"))
    total = F.aggregate("items", F.lit(0.0), lambda a, i: a + F.coalesce(to_number(strip(i["line_total"])), F.lit(0.0)))
    return df.withColumn("items_count", F.size("items")).withColumn("items_total", F.when(F.size("items") > 0, total)).drop("__text")


def parse_invoices(docs: DataFrame) -> DataFrame:
    """One record for each document."""
    df = with_invoice(docs)
    sums = F.when(F.col("subtotal").isNull() & F.col("items_total").isNotNull(), number_cell(F.col("items_total"))).otherwise(text_cell(F.col("subtotal")))
    texts = ("invoice_id", "date", "vendor", "client", "tax_id")
    fields = [entry(k, text_cell(F.col(k))) for k in texts] + [entry("subtotal", sums)] + [entry(k, text_cell(F.col(k))) for k in ("tax", "total")]
    fields += [entry("items", json_cell(F.to_json("items", {"ignoreNullFields": "false"}))), entry("items_count", number_cell(F.col("items_count")))]
    return df.select("file_ord", F.lit(0).alias("rec_ord"), F.col("file_name").alias("source_file"), F.lit("invoice").alias("doc_type"), F.array(*fields).alias("entries"))
