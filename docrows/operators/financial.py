"""Financial statements: typed records from cell grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import clean_headers
from ..functions.lexicon import COMPANY, CURRENCY_UNIT, FINANCIAL_DATE
from ..functions.numbers import to_financial
from ..functions.tables import financial_header_row, table_type
from ..functions.text import first_match, strip
from .model import ENTRIES, as_map, entry, number_cell, text_cell
from .report import numbered


def metadata(text: Column) -> Column:
    """company, report_date, currency_unit."""
    return F.struct(
        first_match(text, COMPANY, flags="md").alias("company"), first_match(text, FINANCIAL_DATE, flags="id").alias("report_date"),
        first_match(text, CURRENCY_UNIT, flags="id").alias("currency_unit"),
    )


def value_cell(c: Column) -> Column:
    number = to_financial(c)
    return F.when(number.isNotNull(), number_cell(number)).otherwise(text_cell(strip(c)))


def row_entries(headers: Column, row: Column, company: Column, unit: Column) -> Column:
    """``line_item`` from the first cell unless it is a number, the other cells by header; null if nothing is left."""
    first = strip(F.get(row, F.lit(0)))
    named = F.when(first.isNotNull() & (first != "") & ~first.rlike("(?U)^[0-9,.\\-()$\\s]+$"), F.array(entry("line_item", text_cell(first)))).otherwise(F.array().cast(ENTRIES))
    name = lambda i: F.coalesce(F.get(headers, i + 1), F.concat(F.lit("col_"), (i + 1).cast("string")))
    cells = F.transform(F.slice(row, F.lit(2), F.size(row)), lambda c, i: F.struct(name(i).alias("k"), value_cell(c).alias("v")))
    cells = F.filter(cells, lambda e: (e["v"]["t"] == "n") | (e["v"]["s"] != ""))
    both = F.concat(named, cells)
    return F.when(F.size(both) > 0, as_map(F.concat(both, F.array(entry("company", text_cell(company)), entry("currency_unit", text_cell(unit))))))


def parse_financials(docs: DataFrame) -> DataFrame:
    """A record for each row that has data, with its table's number and kind and its own number, from 1."""
    m = metadata(F.coalesce("text", F.lit("")))
    d = docs.withColumn("company", F.coalesce(m["company"], F.lit(""))).withColumn("unit", F.coalesce(m["currency_unit"], F.lit("")))
    t = d.select("*", F.posexplode("tables").alias("table_ord", "table")).where(F.size("table") >= 2)
    t = t.withColumn("kind", table_type(F.col("table"))).withColumn("at", financial_header_row(F.col("table")))
    t = t.withColumn("headers", clean_headers(F.get("table", "at"), longest=50, name_blank=False))
    r = t.select("*", F.posexplode(F.slice("table", F.col("at") + 2, F.size("table"))).alias("row_ord", "row")).drop("table", "tables")
    r = r.withColumn("entries", row_entries(F.col("headers"), F.col("row"), F.col("company"), F.col("unit"))).where("entries IS NOT NULL")
    own = F.array(
        entry("_table_index", number_cell(F.col("table_ord") + 1)), entry("_row_index", number_cell(F.col("at") + F.col("row_ord") + 2)),
        entry("_table_type", text_cell(F.col("kind"))),
    )
    return numbered(r.withColumn("entries", as_map(F.concat("entries", own))), "financial_report")
