"""Dates from text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import DATE_FIELDS, DATE_FORMATS, DATE_SHAPES, SPANISH_MONTHS
from .text import has_term, let


def looks_like_date(value: Column, field: Column) -> Column:
    marked = F.contains(value, F.lit("/")) | F.contains(value, F.lit("-")) | value.rlike("[dD][eE]")  # each shape has one of these
    return has_term(F.lower(field), DATE_FIELDS) | (marked & value.rlike("(?iU)" + "|".join(DATE_SHAPES)))


def english_months(c: Column) -> Column:
    """Lower-cased, with Spanish months' names in English; a text without a word of letters has none."""
    named = low = F.lower(c)
    for name, month in SPANISH_MONTHS.items():
        named = F.replace(named, F.lit(name), F.lit(month))
    return F.when(c.rlike("[A-Za-z]{4}"), named).otherwise(low)


#: The English words of dates, and words and parts of words between them that mean nothing.
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_WORDS = ENGLISH_MONTHS + tuple(m[:3] for m in ENGLISH_MONTHS) + ("sept",)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "wed", "thu", "fri", "sat", "sun")
FILLERS = ("at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th")
#: A time of day, which is passed over: 12 hours with am or pm, or 24, with a zone or without.
_HALF, _ZONE = "(?:0?[0-9]|1[0-2])", "(?: ?z(?![a-z])| ?[+-][0-9]{2}(?::?[0-9]{2})?(?![0-9:]))?"
_CLOCK = "[0-5]?[0-9](?::[0-5]?[0-9](?:[.,][0-9]{1,6})?)?"
TIME = f"(?<![0-9.:/-])(?:{_HALF}(?::{_CLOCK})? ?[ap]m?(?![a-z])|(?:[01]?[0-9]|2[0-3]):{_CLOCK}(?![0-9:]){_ZONE})"


#: What spoils a free form: other characters, a decimal, a part missing after its separator, a word joined to a number that can't be a day.
_ODD = (
    "[^0-9a-z ./,;'-]", "(?<![0-9.])[0-9]+\\.[0-9]+(?![0-9.])", "(?<![0-9a-z])(?<![0-9][./-])[0-9]+([./-])[0-9a-z]+\\1(?![0-9a-z])", "(?<![0-9])[0-9]{3}(?![0-9])",
    f"(?<![0-9])(?:00?|3[2-9]|[4-9][0-9]|[0-9]{{4}})(?=[a-z])(?!(?:{'|'.join(FILLERS)})(?![a-z]))",
)
#: A month and ``of`` make the number after it a year, which from then on has three digits, the first a zero.
_OF_YEAR = f"({'|'.join(MONTH_WORDS)}) of ([0-9]{{%d}})(?![0-9])"
#: After a time, a hyphen that doesn't join two parts begins a zone.
_ZONED = f"^[ ,]*{TIME}.*(?:[^0-9a-z]|[0-9](?:st|nd|rd|th)|^)-"


def free_date(c: Column) -> Column:
    """Date of a free form, day first; null where a part of it lacks or a word isn't one of a date.

    Numbers, a month's word, fillers, weekdays and a time are told apart; what the numbers are follows from their order: the
    year first if it has over two digits or is over 31 (with the day after it, where the last number can be a month), else
    the day, else the month where the second number can't be one. Years of two digits are those within 50 of this one.
    """

    def read(x: Column) -> Column:
        odd = x.rlike("|".join(_ODD))
        x = F.regexp_replace(F.regexp_replace(x, _OF_YEAR % 2, "$1 0$2"), _OF_YEAR % 1, "$1 00$2")
        words = F.filter(F.regexp_extract_all(x, F.lit("[0-9]+|[a-z]+"), F.lit(0)), lambda w: ~w.isin(*FILLERS, *WEEKDAYS))
        return F.when(~odd, let(words, three))

    def three(w: Column) -> Column:
        """The three parts, as numbers; a number of 6 or 8 digits is all of them, and may have hours after it."""
        only = F.get(w, F.lit(0))
        cut = lambda *at: F.array(*(F.substring(only, a, n) for a, n in at))
        joined = F.when(only.rlike("^[0-9]{6}$"), cut((1, 2), (3, 2), (5, 2))).when(only.rlike("^[0-9]{8}(([01][0-9]|2[0-3])[0-5][0-9]([0-5][0-9])?)?$"), cut((1, 4), (5, 2), (7, 2)))
        return let(F.when(F.size(w) == 3, w).when(F.size(w) == 1, joined), lambda p: F.when(F.size(p) == 3, dated(p)))

    def number(w: Column) -> Column:
        month = F.when(w.isin(*MONTH_WORDS), ((F.instr(F.lit("".join(m[:3] for m in ENGLISH_MONTHS)), F.substring(w, 1, 3)) + 2) / 3).cast("int"))
        return F.struct(F.coalesce(month, F.when(w.rlike("^([0-9]{1,2}|0[0-9]{2}|[0-9]{4})$"), w.cast("int"))).alias("n"), month.isNotNull().alias("word"), w.rlike("^[0-9]{3,4}$").alias("year"), w.rlike("^[0-9]{4}$").alias("century"))

    def dated(p: Column) -> Column:
        return let(F.transform(p, number), resolved)

    def resolved(v: Column) -> Column:
        n = [F.get(v, F.lit(k))["n"] for k in range(3)]
        word = [F.get(v, F.lit(k))["word"] for k in range(3)]
        year = [F.get(v, F.lit(k))["year"] for k in range(3)]
        part = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
        a, b, c_ = n
        named = F.when(word[0], F.when(year[2], part(c_, a, b)).when(year[1] | (b > 31), part(b, a, c_)).otherwise(part(c_, a, b)))
        named = named.when(word[1], F.when(year[2], part(c_, b, a)).when(year[0] | (a > 31), part(a, b, c_)).otherwise(part(c_, b, a)))
        named = named.when(word[2], F.when(year[0], part(a, c_, b)).when(year[1] | (b > 31), part(b, c_, a)).otherwise(part(a, c_, b)))
        plain = F.when((a > 31) | year[0], F.when(c_ <= 12, part(a, c_, b)).otherwise(part(a, b, c_))).when((a > 12) | (b <= 12), part(c_, b, a)).otherwise(part(c_, a, b))
        known = F.forall(v, lambda x: x["n"].isNotNull())
        once = (F.size(F.filter(v, lambda x: x["word"])) <= 1) & (F.size(F.filter(v, lambda x: x["year"])) <= 1)
        return F.when(known & once, let(F.coalesce(named, plain), lambda d: day(d, F.exists(v, lambda x: x["century"]))))

    def day(d: Column, written: Column) -> Column:
        now = F.year(F.current_date())
        near = (now / 100).cast("int") * 100 + d["y"]
        near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        text = F.format_string("%04d-%02d-%02d", F.when((d["y"] < 100) & ~written, near).otherwise(d["y"]), d["m"], d["d"])
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")

    return let(F.lower(english_months(c)), lambda x: F.when(~x.rlike(_ZONED), let(F.regexp_replace(x, TIME, " "), read)))


def shape(fmt: str) -> str:
    """A pattern that each text of a format of days, months, years and literal text has; it spares attempts that must fail."""
    out = ""
    for quoted, letters, other in re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z'])", fmt):
        if letters and letters[0] not in "dMy":
            return ""  # another field: no pattern, the format is tried
        out += "\\S+" if letters.startswith("MMM") else "[+-]?[0-9]+" if letters else "".join(f"\\x{{{ord(c):x}}}" for c in quoted or other)
    return f"(?i)^{out}$"


def known_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Date by the first format that fits; null if none does."""
    return let(english_months(c), lambda x: F.coalesce(*(F.when(x.rlike(shape(f)), F.try_to_timestamp(x, F.lit(f)).cast("date")) for f in formats)))


def to_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS, guess: bool = True) -> Column:
    """Date by the first format that fits, else by a guess at free forms; null if neither does."""
    known = known_date(c, formats)
    if not guess:
        return known
    return F.coalesce(known, free_date(c))


def normal_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS, out: str = "yyyy-MM-dd", guess: bool = True) -> Column:
    """The date in the format ``out``, or the text as it is where it is none."""
    return F.coalesce(F.date_format(to_date(c, formats, guess), out), c)


def iso_date(c: Column) -> Column:
    """Date of an ISO text, yyyy-MM-dd with or without a time, or yyyyMMdd; slashes count as hyphens. Null for other forms."""
    x = F.replace(c, F.lit("/"), F.lit("-"))
    day = F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), x.substr(1, 10))
    day = F.coalesce(day, F.when(x.rlike("^[0-9]{8}$"), F.concat_ws("-", x.substr(1, 4), x.substr(5, 2), x.substr(7, 2))))
    return F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date")
