"""Tabular reports: records from cell grids, or from delimited text where there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.headers import clean_headers
from ..functions.lexicon import DELIMITERS, REPORT_PATTERNS
from ..functions.tables import empty_row, report_header_row, summary_row
from ..functions.text import blank, first_match, let, strip
from .model import as_map, entry, text_cell


def row_entries(headers: Column, row: Column) -> Column:
    """Cells by header as far as headers reach, blanks null; null if no cell has text."""
    value = lambda c: F.when(strip(c) != "", strip(c))
    cells = F.transform(F.slice(row, F.lit(1), F.size(headers)), lambda c, i: F.struct(F.get(headers, i).alias("k"), text_cell(value(c)).alias("v")))
    return F.when(F.exists(F.slice(row, F.lit(1), F.size(headers)), lambda c: ~blank(c)), as_map(cells))


def table_rows(docs: DataFrame, header_rows: int = 3, min_columns: int = 2) -> DataFrame:
    """Rows below the header of each table: docs' columns, table_ord, row_ord, headers, row."""
    t = docs.select("*", F.posexplode("tables").alias("table_ord", "table")).where(F.size("table") >= 2)
    t = t.withColumn("at", report_header_row(F.col("table"), header_rows, min_columns))
    t = t.withColumn("headers", clean_headers(F.get("table", "at"))).where(F.size("headers") >= min_columns)
    return t.select("*", F.posexplode(F.slice("table", F.col("at") + 2, F.size("table"))).alias("row_ord", "row")).drop("table", "at", "tables")


def table_records(tables: Column, header_row: int = 0) -> Column:
    """Entries of each row below a given header row, table by table: cells by header, those beyond the headers left out.

    An empty header is ``col_i``; of equal headers the last one's cell counts; a row without a filled cell has no entries.
    """

    def rows(t: Column) -> Column:
        head = F.transform(F.get(t, F.lit(header_row)), lambda h, i: F.when(F.coalesce(h, F.lit("")) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(strip(h)))
        own = F.filter(F.slice(t, header_row + 2, F.greatest(F.size(t), F.lit(1))), lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
        pairs = lambda r, h: as_map(F.transform(F.slice(r, F.lit(1), F.size(h)), lambda c, i: F.struct(F.get(h, i).alias("k"), text_cell(c).alias("v"))))
        return let(head, lambda h: F.transform(own, lambda r: pairs(r, h)))

    return F.flatten(F.transform(F.filter(tables, lambda t: (F.size(t) > header_row) & (F.size(F.get(t, F.lit(header_row))) > 0)), rows))


def delimiter(text: Column, min_columns: int = 2) -> Column:
    """First of tab, bar, semicolon and two spaces that 60 % of the filled lines among the first ten have equally often.

    Of counts that are equally common the smallest is taken. Null if there is none, or under two lines.
    """

    def common(head: Column, mark: str) -> Column:
        counts = F.transform(head, lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(mark)))) / len(mark)).cast("int"))
        often = lambda all_: F.transform(all_, lambda v: F.struct(F.size(F.filter(all_, lambda w: w == v)).alias("n"), (-v).alias("less")))
        return let(counts, lambda all_: F.array_max(often(all_)))

    fits = lambda head: lambda best: (-best["less"] >= min_columns - 1) & (best["n"] >= F.size(head) * 0.6)
    first = lambda head: F.coalesce(*(F.when(let(common(head, m), fits(head)), F.lit(m)) for m in DELIMITERS))
    filled = lambda lines: F.filter(F.slice(lines, 1, 10), lambda x: ~blank(x))
    return let(F.split(text, "\n"), lambda lines: F.when(F.size(lines) >= 2, let(filled(lines), first)))


def delimited_rows(docs: DataFrame, min_columns: int = 2) -> DataFrame:
    """Rows of delimited texts, as table_rows has them; the first line with enough parts is the header."""
    d = docs.withColumn("mark", delimiter(F.col("text"), min_columns)).where("mark IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    by = lambda mark: F.transform(F.filter("lines", lambda x: F.contains(x, mark)), lambda x: F.split(x, F.concat(F.lit("\\Q"), mark, F.lit("\\E"))))
    parts = let(F.col("mark"), by)  # the filters below take this to the text, where the mark would be found anew for each line
    d = d.withColumn("lines", lines).where(F.size("lines") >= 2).withColumn("parts", parts)
    at = F.array_position(F.transform("parts", lambda p: F.size(p) >= min_columns), F.lit(True)).cast("int")
    d = d.withColumn("at", at).where("at > 0").withColumn("headers", clean_headers(F.get("parts", F.col("at") - 1)))
    rows = F.posexplode(F.slice("parts", F.col("at") + 1, F.size("parts")))
    return d.select("*", F.lit(0).alias("table_ord"), rows.alias("row_ord", "row")).drop("mark", "lines", "parts", "at", "tables")


def metadata(text: Column) -> Column:
    """title, report_date, period, current_page, total_pages."""
    names = ("title", "report_date", "period")
    found = [first_match(text, REPORT_PATTERNS[k]).alias(k) for k in names]
    page = [F.regexp_extract(text, "(?i)" + REPORT_PATTERNS["page"], g) for g in (1, 2)]
    return F.struct(*found, F.when(page[0] != "", page[0]).alias("current_page"), F.when(page[1] != "", page[1]).alias("total_pages"))


def parse_reports(docs: DataFrame, header_rows: int = 3, min_columns: int = 2, include_metadata: bool = False) -> DataFrame:
    """A record for each row; rows for totals are left out of tables, not of texts."""
    tables = F.coalesce(F.size("tables"), F.lit(0)) > 0
    grid = table_rows(docs.where(tables), header_rows, min_columns).where(~empty_row(F.col("row")) & ~summary_row(F.col("row")))
    rows = grid.unionByName(delimited_rows(docs.where(~tables), min_columns), allowMissingColumns=True)
    rows = rows.withColumn("entries", row_entries(F.col("headers"), F.col("row"))).where("entries IS NOT NULL")
    if include_metadata:
        m = metadata(F.coalesce("text", F.lit("")))
        rows = rows.withColumn("entries", as_map(F.concat("entries", F.array(entry("_report_title", text_cell(m["title"])), entry("_report_date", text_cell(m["report_date"]))))))
    return numbered(rows, "report")


def numbered(rows: DataFrame, doc_type: str) -> DataFrame:
    """Records in the order of tables and rows, numbered within each file."""
    place = F.row_number().over(W.partitionBy("file_ord").orderBy("table_ord", "row_ord")) - 1
    return rows.select("file_ord", place.alias("rec_ord"), F.col("file_name").alias("source_file"), F.lit(doc_type).alias("doc_type"), "entries")
