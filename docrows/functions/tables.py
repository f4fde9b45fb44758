"""Functions of cell grids, which are arrays of rows of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ITEM_FIELDS, ITEM_TERMS, SUMMARY_TERMS, TABLE_TERMS
from .text import blank, collapse, count_terms, has_term, let, strip


def clean_table(table: Column, min_rows: int = 2, min_cols: int = 2) -> Column:
    """Cells collapsed, ``nan``, ``none`` and blanks null, short rows padded with nulls; null if the table is too small.

    Rows are cleaned once and their width is found once, not again for each row.
    """
    said = lambda c, kept: F.when((F.length(c) > 4) | ~F.lower(c).isin("", "nan", "none"), kept(c))
    cell = lambda c: F.when(c.rlike("^[!-~]+$"), said(c, lambda c: c)).otherwise(let(strip(c), lambda c: said(c, collapse)))  # noqa: E731 - a text without any white space is as it should be
    rows = F.transform(F.filter(table, lambda r: F.size(r) > 0), lambda r: F.transform(r, cell))
    pad = lambda r, width: F.when(F.size(r) < width, F.concat(r, F.array_repeat(F.lit(None).cast("string"), width - F.size(r)))).otherwise(r)
    sized = lambda rs, width: F.when((F.size(rs) >= min_rows) & (width >= min_cols), F.transform(rs, lambda r: pad(r, width)))
    return let(rows, lambda rs: let(F.array_max(F.transform(rs, F.size)), lambda width: sized(rs, width)))


def clean_tables(tables: Column, min_rows: int = 2, min_cols: int = 2) -> Column:
    return F.filter(F.transform(tables, lambda t: clean_table(t, min_rows, min_cols)), lambda t: t.isNotNull())


def filter_tables(tables: Column, min_rows: int = 2) -> Column:
    """Tables in which at least ``min_rows`` rows have a cell that isn't empty."""
    return F.filter(tables, lambda t: F.size(F.filter(t, lambda r: F.exists(r, lambda c: c.isNotNull() & (c != "")))) >= min_rows)


def _first_row(table: Column, rows: int, test, missing: Column) -> Column:
    """Number from 0 of the first of the first rows that passes the test."""
    place = F.array_position(F.transform(F.slice(table, 1, rows), lambda r: F.coalesce(test(r), F.lit(False))), F.lit(True))
    return F.when(place > 0, place.cast("int") - 1).otherwise(missing)


def report_header_row(table: Column, rows: int = 3, min_columns: int = 2) -> Column:
    """First row with enough cells of which under half are numbers; 0 if there is none."""

    def test(r: Column) -> Column:
        full = F.filter(r, lambda c: ~blank(c))
        numbers = F.filter(full, lambda c: strip(c).rlike("(?U)^[0-9,.\\-\\s$%]+$"))
        return (F.size(full) >= min_columns) & (F.size(numbers) < F.size(full) * 0.5)

    return _first_row(table, rows, test, F.lit(0))


def financial_header_row(table: Column) -> Column:
    """First of five rows with two years, or with texts in half of its cells; 0 if there is none."""
    filled = lambda c: c.isNotNull() & (c != "")

    def test(r: Column) -> Column:
        years = F.filter(r, lambda c: filled(c) & c.rlike("\\b20[0-9]{2}\\b"))
        texts = F.filter(r, lambda c: filled(c) & ~strip(c).rlike("(?U)^[0-9,.\\-()$\\s]+$"))
        return (F.size(r) > 0) & ((F.size(years) >= 2) | (F.size(texts) >= F.size(r) * 0.5))

    return _first_row(table, 5, test, F.lit(0))


def item_header_row(table: Column) -> Column:
    """First of five rows with two item terms; null if there is none."""
    text = lambda r: F.array_join(F.filter(r, lambda c: c.isNotNull() & (c != "")), " ")
    return _first_row(table, 5, lambda r: count_terms(text(r), ITEM_TERMS) >= 2, F.lit(None).cast("int"))


def item_field(header: Column) -> Column:
    """The item field that a header stands for; null if it stands for none."""

    def named(low: Column) -> Column:
        out = F
        for field, terms in ITEM_FIELDS.items():
            out = out.when(has_term(low, terms), field)
        return out

    return let(F.lower(strip(header)), named)


def table_type(table: Column) -> Column:
    """Kind of a financial table by two or more terms in its first five rows; ``general`` if none fits."""
    cells = F.filter(F.flatten(F.slice(table, 1, 5)), lambda c: c.isNotNull() & (c != ""))
    text, out = F.array_join(cells, " "), F
    for kind, terms in TABLE_TERMS.items():
        out = out.when(count_terms(text, terms) >= 2, kind)
    return out.otherwise("general")


def empty_row(row: Column) -> Column:
    return F.forall(row, blank)


def summary_row(row: Column) -> Column:
    """Whether the first cell has a term for totals."""
    return has_term(F.lower(F.coalesce(F.get(row, F.lit(0)), F.lit(""))), SUMMARY_TERMS)
