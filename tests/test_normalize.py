"""Free dates against dateutil, composition against unicodedata, keys of records."""

from __future__ import annotations

import datetime
import random
import re
import unicodedata

from pyspark.sql import functions as F

from docrows.functions import dates, text
from docrows.operators.dedup import deduplicate
from docrows.operators.model import RECORD
from docrows.operators.normalize import normalize


def dateutil_date(x):
    """The date of a text that names all its parts, without its weekday."""
    from dateutil import parser

    x = re.sub(r"^(mon|tuesday|wed|fri|thursday)[.,]? ", "", x.lower())
    try:
        a, b = (parser.parse(x, dayfirst=True, default=d) for d in (datetime.datetime(2000, 1, 1), datetime.datetime(2003, 2, 2)))
    except (ValueError, TypeError, OverflowError):
        return None
    return a.date().isoformat() if a.date() == b.date() else None


def form(rng):
    d, m = rng.choice([rng.randrange(1, 32), rng.randrange(1, 13)]), rng.randrange(1, 14)
    y = rng.choice([rng.randrange(1900, 2100), rng.randrange(0, 100), rng.randrange(1990, 2030)])
    day = rng.choice([str(d), f"{d:02d}", f"{d}{rng.choice(['st', 'nd', 'rd', 'th'])}"])
    year, word = str(y) if y > 99 else f"{y:02d}", rng.choice(dates.MONTH_WORDS)
    month = rng.choice([str(m), f"{m:02d}", word, word.title(), word.upper(), word[:3] + "."])
    parts = [day, month, year]
    order = rng.random()
    if order < 0.3:
        rng.shuffle(parts)
    elif order < 0.55:
        parts = [month, day, year] if order < 0.45 else [year, month, day]
    sep = rng.choice(["/", "-", " ", ".", ", ", " - ", "/", "-", " ", "", " of "])
    out = sep.join(parts)
    if rng.random() < 0.1:
        out = rng.choice([f"{y if y > 99 else 2000 + y}{m:02d}{d:02d}", f"{y % 100:02d}{m:02d}{d:02d}"])
    if rng.random() < 0.1:
        out = parts[0] + sep + parts[1] + rng.choice([" ", ", ", " '"]) + parts[2]
    if rng.random() < 0.2:
        out = rng.choice(["Mon", "Tuesday", "wed,", "Fri.", "thursday,"]) + " " + out
    if rng.random() < 0.25:
        h, mi, s = rng.randrange(26), rng.randrange(62), rng.randrange(60)
        clock = rng.choice([f"{h}:{mi:02d}", f"{h:02d}:{mi:02d}:{s:02d}", f"{h:02d}:{mi:02d}:{s:02d}.123", f"{h % 13}:{mi:02d} pm", f"{h % 13} am", f"{h % 13}pm", f"{h:02d}:{mi:02d}z", f"{h:02d}:{mi:02d}:{s:02d}+02:00"])
        out = rng.choice([f"{out} {clock}", f"{out}T{clock}", f"{clock} {out}", f"{out} at {clock}", f"{out}, {clock}"])
    return out + (rng.choice([" x", " de", "?", " BC", "(a)"]) if rng.random() < 0.05 else "")


def test_free_dates_equal_dateutil(spark):
    rng = random.Random(5)
    forms = sorted({form(rng) for _ in range(10_500)})
    assert len(forms) >= 10_000
    df = spark.createDataFrame([(f,) for f in [*forms, None, "", "no date", "march 2024"]], "x string").select("x", dates.free_date(F.col("x")).cast("string").alias("d"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.x: r.d for r in df.collect()}
    apart = [(f, got[f], dateutil_date(f)) for f in forms if got[f] != dateutil_date(f)]
    assert len(apart) <= 5, apart  # six or eight digits with hours that look like a part: dateutil reads a date into them
    assert all(d is None for _, d, _ in apart) and sum(v is not None for v in got.values()) > 0.7 * len(forms)
    assert got[None] is None and got[""] is None and got["no date"] is None and got["march 2024"] is None


def test_composition_equals_unicodedata(spark):
    rng = random.Random(6)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    marks = [c for c in every if unicodedata.combining(c)] + [chr(c) for c in range(0x1100, 0x1200)]
    bases = "aeoucnAEsz가각가" + "".join(rng.choice(every) for _ in range(300))
    mixed = ["".join(rng.choice(bases) + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(5)) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in every + mixed], "x string").select("x", text.compose(F.col("x")).alias("y"))
    assert [r.x for r in df.collect() if unicodedata.normalize("NFC", r.x) != r.y] == []
    assert spark.range(1).select(text.compose(F.lit(None).cast("string")).alias("y")).first().y is None


def test_normalizing_stays_in_the_jvm(spark):
    rows = [(0, 0, "f", "invoice", [("Fécha", ("s", "5th of March, 2024 10:30", None)), ("nota", ("s", "café  x", None)), ("total", ("s", "1,5", None)), ("fecha", ("s", "soon", None))])]
    out = normalize(spark.createDataFrame(rows, RECORD))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(e.k, e.v.t, e.v.s, e.v.n) for e in out.first().entries] == [("fécha", "s", "5th of March, 2024 10:30", None), ("nota", "s", "café x", None), ("total", "n", None, 1.5), ("fecha", "s", "soon", None)]
    dated = normalize(spark.createDataFrame([(0, 0, "f", "invoice", [("fecha", ("s", "5th of March, 2024 10:30", None))])], RECORD)).first().entries
    assert dated[0].v.s == "2024-03-05"
    raw = normalize(spark.createDataFrame(rows, RECORD), nfc=False, guess=False).first().entries
    assert raw[1].v.s == "café x"


def test_keys_of_records(spark):
    s, n, none = (lambda x: ("s", x, None)), (lambda x: ("n", None, x)), (None, None, None)
    kinds = [
        [("a", s("1")), ("b", s("2"))], [("b", s("2")), ("a", s("1"))],  # the same: order of names
        [("a", n(0.0))], [("a", n(-0.0)), ("_x", s("internal"))],  # the same: signs of zero, internal fields
        [("a", s("1"))], [("a", n(1.0))], [("a", none), ("s", s("x"))], [("a", s("x")), ("s", none)], [("a", none)], [("a", s(""))], [], [("a", s('1","k":"b'))],
    ]
    rows = [(f, r, "f", "t", kinds[k]) for k, (f, r) in enumerate((k // 5, k % 5) for k in range(len(kinds)))]
    df = spark.createDataFrame(rows + [(9, 2_000_000_000, "f", "t", kinds[4])], RECORD)
    kept = {(r.file_ord, r.rec_ord) for r in deduplicate(df.repartition(5)).collect()}
    assert kept == {(k // 5, k % 5) for k in range(len(kinds)) if k not in (1, 3)}
    last = {(r.file_ord, r.rec_ord): r.entries for r in deduplicate(df.repartition(5), ("a",), "last").collect()}
    assert last[(0, 2)][0].v.n == 0.0 and len(last) == 7


def test_spaces_and_controls_are_all_of_theirs(spark):
    """Each character up to U+3100, between letters: white space is a space, control characters go, others stay; texts of ASCII and others alike."""
    codes = [k for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    df = spark.createDataFrame([(k, f"a{chr(k)}b", f"a {chr(k)}\n b") for k in codes], "k int, one string, run string")
    for r in df.select("k", text.collapse(F.col("one")).alias("one"), text.collapse(F.col("run")).alias("run"), text.clean_text(F.col("one")).alias("clean"), text.ascii_only(F.col("one")).alias("ascii")).collect():
        space, control = chr(r.k) in text.SPACES, r.k in range(9) or r.k in (11, 12, 127) or r.k in range(14, 32)
        assert r.one == ("a b" if space else f"a{chr(r.k)}b") and r.run == ("a b" if space else f"a {chr(r.k)} b"), r.k
        assert r.clean == ("ab" if control else "a b" if space else f"a{chr(r.k)}b") and r.ascii == (r.k < 128), r.k
