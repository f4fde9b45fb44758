"""Text functions. White space is Unicode's, as ``(?U)\\s`` has it, given as a set so that trimming needs no pattern."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters and what stands for them.
PLAIN = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u00a0": " "}
ELLIPSIS = "\u2026"
#: The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with c evaluated once, also where it stands in a lambda."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


#: The same characters as a set, in which printable ASCII characters are told by the first comparison.
SPACE_SET = "[[^!-~]&&[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"


def collapse(c: Column) -> Column:
    """Each run of white space is one space."""
    return F.regexp_replace(c, f"{SPACE_SET}+", " ")


def ascii_only(c: Column) -> Column:
    """A text of ASCII alone has as many bytes as characters."""
    return F.octet_length(c) == F.length(c)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def clean_text(c: Column) -> Column:
    """Without control characters; all white space, newlines too, collapsed; stripped."""
    return strip(collapse(F.regexp_replace(c, "[\\p{Cntrl}&&[^\\t\\n\\r]]", "")))


#: The class of the Unicode library that Spark brings along for its collations.
NORMALIZER = "com.ibm.icu.text.Normalizer"


def compose(c: Column) -> Column:
    """Canonical composition (NFC), in the JVM. Only texts with non-ASCII characters are looked at."""
    return F.when(~ascii_only(c), F.java_method(F.lit(NORMALIZER), F.lit("compose"), c, F.lit(False))).otherwise(c)


def plain_characters(c: Column) -> Column:
    return F.when(~ascii_only(c), F.replace(F.translate(c, "".join(PLAIN), "".join(PLAIN.values())), F.lit(ELLIPSIS), F.lit("..."))).otherwise(c)


def fix_unicode(c: Column) -> Column:
    """Canonical composition, then plain quotes, dashes, spaces and dots."""
    return plain_characters(compose(c))


def normal_text(c: Column, nfc: bool = True) -> Column:
    return strip(collapse(fix_unicode(c) if nfc else plain_characters(c)))


def first_match(c: Column, pattern: str, groups: int = 1, flags: str = "imd") -> Column:
    """First group that isn't blank in the first match, stripped; null if there is none."""
    found = F.array(*(strip(F.regexp_extract(c, f"(?{flags}){pattern}", g)) for g in range(1, groups + 1)))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))  # each group is taken out once


def all_matches(c: Column, pattern: str, group: int = 1, flags: str = "imd") -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?{flags}){pattern}"), F.lit(group)), strip)


def count_terms(c: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a text contains in lower case."""
    return let(F.lower(F.coalesce(c, F.lit(""))), lambda low: count_in(low, terms))


def count_in(low: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a text contains as it is."""
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(t)).cast("int") for t in terms))


def has_term(c: Column, terms: tuple[str, ...]) -> Column:
    return let(c, lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(t)) for t in terms)))


def split_sections(c: Column, patterns: list[str]) -> Column:
    """Sections that begin at a match of any pattern, as a map from the lower-cased match to the text up to the next one.

    A later section with the same name takes the earlier one's place. Text before the first match belongs to none.
    """
    either = "|".join(f"(?:{p})" for p in patterns)
    names = F.transform(F.regexp_extract_all(c, F.lit(f"(?im)({either})"), F.lit(1)), lambda x: F.lower(strip(x)))
    bodies = F.transform(F.slice(F.split(c, f"(?im){either}"), F.lit(2), F.size(names)), strip)
    pairs = F.arrays_zip(names.alias("k"), bodies.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)
