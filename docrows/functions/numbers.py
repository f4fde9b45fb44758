"""Numbers from text. The general and the financial reading differ in what a lone comma means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CURRENCIES, NUMBER_FIELDS
from .text import has_term, let, strip


def to_double(c: Column) -> Column:
    """Double where the text is a plain decimal number; null otherwise."""
    return F.when(c.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark)))


def _without(c: Column, mark: str, by: str = "") -> Column:
    return F.replace(c, F.lit(mark), F.lit(by))


def without_currency(c: Column) -> Column:
    bare = c
    for mark in CURRENCIES:
        bare = _without(bare, mark)
    return strip(F.when(c.rlike("\\$|[A-Z]{3}"), bare).otherwise(c))  # all marks have one of these


def to_number(c: Column) -> Column:
    """General reading: of two kinds of separators the later one is decimal, one kind that repeats groups digits.

    A lone comma is decimal before one or two digits and spoils the number before more; a lone dot is decimal.
    """
    def read(x: Column) -> Column:
        commas, dots = _count(x, ","), _count(x, ".")
        last = lambda mark: F.length(F.substring_index(x, mark, -1))
        plain = (
            F.when((commas == 1) & (dots == 0), F.when(x.rlike(",[0-9]{1,2}$"), _without(x, ",", ".")).otherwise(x))
            .when((dots == 1) & (commas == 0), x)
            .when((commas > 0) & (dots > 0), F.when(last(",") < last("."), _without(_without(x, "."), ",", ".")).otherwise(_without(x, ",")))
            .otherwise(_without(_without(x, ","), "."))
        )
        return let(strip(plain), to_double)

    return let(without_currency(c), read)


def to_financial(c: Column) -> Column:
    """Financial reading: parentheses negate, and a lone comma before exactly three digits groups them."""
    def read(y: Column) -> Column:
        last = lambda mark: F.length(F.substring_index(y, mark, -1))
        both = F.contains(y, F.lit(",")) & F.contains(y, F.lit("."))
        plain = (
            F.when(both, F.when(last(",") < last("."), _without(_without(y, "."), ",", ".")).otherwise(_without(y, ",")))
            .when(y.rlike(",[0-9]{3}(,|$)"), _without(y, ",")).otherwise(_without(y, ",", "."))
        )
        return let(plain, to_double)

    def signed(x: Column) -> Column:
        inner = F.regexp_extract(x, "^\\(([0-9,.]+)\\)$", 1)
        return F.when(x.rlike("^\\(([0-9,.]+)\\)$"), -let(inner, read)).otherwise(let(F.regexp_replace(x, "(?U)[$\\s]", ""), read))

    return let(strip(c), signed)


def looks_like_number(value: Column, field: Column) -> Column:
    """By the field's name, or by digits and separators alone besides currency marks."""
    digits = let(without_currency(value), lambda x: x.rlike("(?U)^[0-9\\s,.\\-+]+$") & x.rlike("[0-9]"))
    return has_term(F.lower(field), NUMBER_FIELDS) | (~value.rlike("[a-z]") & digits)  # no currency mark has a small letter
