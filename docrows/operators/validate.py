"""Validation rules as columns. Errors are data: an array of (field, code, message) for each record."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.lexicon import CHECKED_DATES, MESSAGES, TOTAL_FIELDS
from ..functions.text import blank, let
from .model import cell

ERROR = "struct<field:string,code:string,message:string>"


def message(key: str, field: str, value: Column | None = None, limit: object = None) -> Column:
    """A message of the list, with the field's name, the value and the limit in their places."""
    text = MESSAGES[key].replace("{field}", field).replace("{limit}", str(limit))
    before, mark, after = text.partition("{value}")
    return F.concat(F.lit(before), value, F.lit(after)) if mark else F.lit(text)


@dataclass(frozen=True)
class FieldRule:
    """Constraints of one field; ``type`` is string, number, date or boolean, and any other type passes."""

    name: str
    type: str = "string"
    required: bool = False
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed_values: tuple = ()

    def checks(self, v: Column) -> list[tuple[str, Column, str | Column]]:
        """(code, condition, message) for the field's cell, in the order in which errors are told."""
        t, s, n = v["t"], v["s"], v["n"]
        there = t.isNotNull()
        number, text = (t == "n") | (t == "b"), t == "s"
        shown = F.coalesce(s, n.cast("string"))
        value = F.when(t == "b", (s == "true").cast("double")).otherwise(n)
        say = lambda key, **more: message(key, self.name, shown, **more)
        out: list[tuple[str, Column, str | Column]] = []
        if self.type == "string":
            out.append(("type_string", there & ~text, say("text")))
        elif self.type == "number":
            out.append(("type_number", there & ~number, say("number")))
            if self.min is not None:
                out.append(("min", number & (value < float(self.min)), say("min", limit=self.min)))
            if self.max is not None:
                out.append(("max", number & (value > float(self.max)), say("max", limit=self.max)))
        elif self.type == "date":
            out.append(("type_date_parse", text & iso_date(s).isNull(), say("not_a_date")))
            out.append(("type_date_kind", there & ~text, say("date")))
        elif self.type == "boolean":
            out.append(("type_boolean", there & (t != "b"), say("boolean")))
        if self.type == "string" and self.min_length is not None:
            out.append(("min_length", text & (F.length(s) < self.min_length), say("short", limit=self.min_length)))
        if self.type == "string" and self.max_length is not None:
            out.append(("max_length", text & (F.length(s) > self.max_length), say("long", limit=self.max_length)))
        if self.pattern is not None:
            out.append(("pattern", text & ~s.rlike(f"\\A(?:{self.pattern})"), say("pattern")))
        if self.allowed_values:
            texts = [x for x in self.allowed_values if isinstance(x, str)]
            numbers = [float(x) for x in self.allowed_values if not isinstance(x, str)]
            known = (text & s.isin(texts)) | (number & value.isin(numbers))
            out.append(("allowed", there & ~known, say("allowed")))
        if not self.required:
            return out
        missing = ~there | (text & blank(s))
        return [("required", missing, say("required")), *((c, ~missing & x, m) for c, x, m in out)]


@dataclass(frozen=True)
class GlobalRules:
    non_negative_totals: bool = True
    valid_dates: bool = True

    def names(self) -> tuple[str, ...]:
        return (TOTAL_FIELDS if self.non_negative_totals else ()) + (CHECKED_DATES if self.valid_dates else ())

    def checks(self, cells: dict[str, Column]) -> list[tuple[str, str, Column, Column | str]]:
        out = []
        for name in TOTAL_FIELDS if self.non_negative_totals else ():
            v = cells[name]
            out.append((name, "global_negative", (v["t"] == "n") & (v["n"] < 0), message("negative", name, v["n"].cast("string"))))
        for name in CHECKED_DATES if self.valid_dates else ():
            v = cells[name]
            day, given = iso_date(v["s"]), (v["t"] == "s") & (v["s"] != "")
            out.append((name, "global_date", given & day.isNull(), message("not_a_date", name)))
            out.append((name, "global_year", given & ((F.year(day) < 1900) | (F.year(day) > 2100)), message("year", name)))
        return out


@dataclass(frozen=True)
class Validation:
    """Rules, and what becomes of records with errors: ``warn`` keeps them, ``skip`` drops them, ``fail`` stops the run."""

    rules: tuple[FieldRule, ...] = ()
    global_rules: GlobalRules = field(default_factory=GlobalRules)
    enabled: bool = True
    on_error: str = "warn"
    max_errors: int = 10


def with_errors(records: DataFrame, rules: Iterable[FieldRule], shared: GlobalRules | None = None, typed: dict[str, Iterable[FieldRule]] | None = None) -> DataFrame:
    """Adds ``errors``. ``typed``: rules for the records of one doc_type. Rows are numbered from 1 within each file in the messages; nothing is shuffled."""
    row = F.concat(F.lit(MESSAGES["row"]), (F.col("rec_ord") + 1).cast("string"), F.lit(": "))
    rules, shared = list(rules), shared or GlobalRules()
    own = [(kind, r) for kind, some in (typed or {}).items() for r in some]
    names = list(dict.fromkeys([r.name for r in rules] + [r.name for _, r in own] + list(shared.names())))
    bound = {n: f"c{i}" for i, n in enumerate(names)}

    def told(all_: Column) -> list[tuple[str, str, Column, Column | str]]:
        cells = {n: all_[c] for n, c in bound.items()}
        out = [(r.name, *c) for r in rules for c in r.checks(cells[r.name])]
        out += [(r.name, code, (F.col("doc_type") == kind) & when, text) for kind, r in own for code, when, text in r.checks(cells[r.name])]
        return out + shared.checks(cells)

    def one(name: str, code: str, when: Column, text: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(code).alias("code"), F.concat(row, text).alias("message")))

    if not names:
        return records.withColumn("errors", F.array().cast(f"array<{ERROR}>"))
    # entries are made once and each field is looked up once, also where a filter on the errors takes all of this below
    looked_up = lambda entries: F.struct(*(cell(entries, n).alias(c) for n, c in bound.items()))
    found = lambda all_: F.filter(F.array(*(one(*t) for t in told(all_))).cast(f"array<{ERROR}>"), lambda e: e.isNotNull())
    own_entries = F.filter("entries", lambda e: e["k"].isin(*names))  # fields are looked up among these alone
    return records.withColumn("errors", let(own_entries, lambda entries: let(looked_up(entries), found)))


def validate(records: DataFrame, v: Validation, typed: dict[str, Iterable[FieldRule]] | None = None) -> DataFrame:
    """Records with ``errors``, treated as ``on_error`` says. ``fail`` raises if there are more than ``max_errors`` errors."""
    if not v.enabled:
        return records.withColumn("errors", F.array().cast(f"array<{ERROR}>"))
    out = with_errors(records, v.rules, v.global_rules, typed)
    if v.on_error == "skip":
        return out.where(F.size("errors") == 0)
    if v.on_error == "fail" and (n := out.agg(F.sum(F.size("errors"))).first()[0] or 0) > v.max_errors:
        raise ValueError(f"{n} validation errors; at most {v.max_errors} are allowed")
    return out


def renumber(records: DataFrame) -> DataFrame:
    """Number records within each file again, in their order."""
    return records.withColumn("rec_ord", F.row_number().over(W.partitionBy("file_ord").orderBy("rec_ord")) - 1)


class NonNegative(FieldRule):
    """A number of at least 0."""

    def __init__(self, name: str):
        super().__init__(name, type="number", min=0)


class Required(FieldRule):
    """A value that isn't blank, of any type."""

    def __init__(self, name: str):
        super().__init__(name, type="any", required=True)


class InRange(FieldRule):
    """A number between two bounds, which count as inside."""

    def __init__(self, name: str, least: float | None = None, most: float | None = None):
        super().__init__(name, type="number", min=least, max=most)
