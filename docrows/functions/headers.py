"""Header functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let, plain_characters, strip


def normal_header(c: Column, lower: bool = True) -> Column:
    """Runs of white space, hyphens and dots are ``_``, other marks go; ``unnamed_column`` if nothing is left. A name that is normal already is only told to be."""
    x = plain_characters(strip(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(F.regexp_replace(x, "(?U)[\\s\\-.]+", "_"), "(?U)[^\\w]", "")
    x = F.regexp_replace(x, "^_+|_+$", "")
    x = F.lower(x) if lower else x
    return F.when(c.rlike("\\A[a-z0-9](?:[a-z0-9_]*[a-z0-9])?\\z"), c).otherwise(let(x, lambda x: F.when(x == "", "unnamed_column").otherwise(x)))


def clean_headers(row: Column, longest: int | None = None, name_blank: bool = True) -> Column:
    """Names of a header row: white space collapsed, repeats (in any case) with the suffix ``_1``, ``_2``, ...

    ``name_blank``: a blank cell is ``col_i`` and takes part in the numbering; otherwise only a null or empty cell is
    ``col_i``, and other headers don't heed it. ``longest``: longer names are cut before they are numbered.
    """

    def add(names: Column, cell: Column) -> Column:
        place = F.concat(F.lit("col_"), F.size(names).cast("string"))
        cut = lambda text: text if longest is None else F.substring(text, 1, longest)
        taken = lambda t: let(F.lower(t), lambda low: F.exists(names, lambda n: n["heeded"] & (n["low"] == low)))
        after = lambda base: F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.concat(base, F.lit("_"), k.cast("string")))
        free = lambda base: F.when(~taken(base), base).otherwise(F.get(F.filter(after(base), lambda t: ~taken(t)), F.lit(0)))
        add_one = lambda name, heeded: F.concat(names, F.array(F.struct(name.alias("name"), heeded.alias("heeded"), F.lower(name).alias("low"))))

        def named(text: Column) -> Column:
            if name_blank:
                return let(F.when(text == "", place).otherwise(text), lambda base: let(free(base), lambda name: add_one(name, F.lit(True))))
            unnamed = F.coalesce(cell, F.lit("")) == ""
            return let(F.when(unnamed, place).otherwise(free(text)), lambda name: add_one(name, ~unnamed))

        return let(cut(strip(collapse(F.coalesce(cell, F.lit(""))))), named)

    none = F.array().cast("array<struct<name:string,heeded:boolean,low:string>>")
    return F.aggregate(row, none, add, lambda names: F.transform(names, lambda n: n["name"]))
