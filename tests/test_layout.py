"""Tables from words and lines, and pages decoded one by one."""

from __future__ import annotations

import os
import random
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from docrows.operators import layout
from docrows.plans.config import from_dict
from docrows.sources import pdf_text
from docrows.sources.documents import Decoder, DocumentSource, page_counts, read_documents, read_page_tables, read_pages
from docrows.sources.pages import register_page_source

WORDS = "path string, page_ord int, x0 double, x1 double, top double, bottom double, text string"
RULES = "path string, page_ord int, x0 double, y0 double, x1 double, y1 double"


def pdf(*contents: str, fonts: str = "") -> bytes:
    """A file of one content stream for each page, 600 points high."""
    kids = [10 + 2 * k for k in range(len(contents))]
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /MediaBox [0 0 500 600] {fonts} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>"}
    for k, c in zip(kids, contents):
        objects |= {k: f"<< /Type /Page /Parent 2 0 R /Contents {k + 1} 0 R >>", k + 1: f"<< /Length {len(c)} >>\nstream\n{c}\nendstream"}
    return ("%PDF-1.4\n" + "".join(f"{n} 0 obj\n{body}\nendobj\n" for n, body in objects.items()) + "trailer << /Root 1 0 R >>\n%%EOF").encode("latin-1")


def say(x, y, text):
    return f"BT /F1 10 Tf 1 0 0 1 {x} {y} Tm ({text}) Tj ET\n"


def words_at(page, x, top, text, path="p"):
    out, x, top = [], float(x), float(top)
    for word in text.split():
        out.append((path, page, x, x + 5.0 * len(word), top, top + 10.0, word))
        x += 5.0 * (len(word) + 1)
    return out


def tables_of(spark, words, rules=None, aligned=True):
    rules = None if rules is None else spark.createDataFrame(rules, RULES)
    found = layout.find_tables(spark.createDataFrame(words, WORDS), rules, aligned=aligned).collect()
    return {p: [r.grid for r in sorted((r for r in found if r.page_ord == p), key=lambda r: r.table_ord)] for p in {r.page_ord for r in found}}


def test_layout_of_a_content_stream():
    fonts = "/Resources << /Font << /F1 5 0 R /F2 6 0 R >> >>"
    body = "q 2 0 0 2 10 20 cm BT /F1 5 Tf 1 0 0 1 5 10 Tm [(AB) -50 (C) -900 (D)] TJ 0 -6 Td (x y) Tj T* ET Q\n20 30 m 20 130 l S 10 10 100 50 re f 0 0 m 9 40 l S 1 1 m 1 90 l n\nBT /F2 10 Tf 14 TL 100 500 Td (lo) Tj (ng) Tj (up) ' ET"
    raw = pdf(body, fonts=fonts).replace(b"trailer", b"5 0 obj\n<< /FirstChar 65 /Widths [1000 600 600 600] >>\nendobj\ntrailer", 1)
    words, rules = pdf_text.PdfPages(raw).layout(0)
    near = lambda a, b: all(x == y if isinstance(x, str) else x == pytest.approx(y) for x, y in zip(a, b))
    want = [(20, 42.5, 552, 562, "ABC"), (51.5, 57.5, 552, 562, "D"), (20, 25, 564, 574, "x"), (30, 35, 564, 574, "y"), (100, 120, 92, 102, "long"), (100, 110, 106, 116, "up")]
    assert len(words) == len(want) and all(near(a, b) for a, b in zip(words, want)), words
    assert rules == [(20, 570, 20, 470), (10, 590, 110, 590), (10, 540, 110, 540), (10, 590, 10, 540), (110, 590, 110, 540)]
    assert pdf_text.PdfPages(b"junk").layout(0) == ([], []) and len(pdf_text.PdfPages(b"junk")) == 0


def test_objects_in_object_streams():
    """Pages and fonts packed into a compressed stream, as later versions of the format keep them; the contents stand alone."""
    kids = {5: "<< /Type /Page /Parent 2 0 R /Contents 20 0 R >>", 2: "<< /Type /Pages /Kids [4 0 R 5 0 R] /MediaBox [0 0 500 600] >>", 4: "<< /Type /Page /Parent 2 0 R /Contents 21 0 R >>", 1: "<< /Type /Catalog /Pages 2 0 R >>"}
    body, head = "", ""
    for n, text in kids.items():
        head += f"{n} {len(body)} "
        body += text + " "
    packed = zlib.compress((head + body).encode())
    contents = {20: say(50, 500, "second"), 21: say(50, 500, "first")}
    raw = b"%%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 4 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    raw += b"".join(f"{n} 0 obj\n<< /Length {len(c)} >>\nstream\n{c}\nendstream\nendobj\n".encode() for n, c in contents.items())
    file = pdf_text.PdfPages(raw)
    assert [file.text(k) for k in range(len(file))] == ["first", "second"] and file.layout(1)[0] == [(50, 80, 92, 102, "second")]
    assert len(pdf_text.PdfPages(raw.replace(b"/First", b"/Fist"))) == 2  # content streams alone are left


@pytest.mark.parametrize("seed", range(3))
def test_planted_grids(spark, seed):
    """Ruled and aligned grids at random, a page each: ragged rows, wrapped cells, spanning cells, two tables on a page."""
    rng = random.Random(seed)
    words, rules, planted = [], [], {}
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 7)))
    for page in range(24):
        ruled, n, m = page % 2 == 0, rng.randrange(2, 9), rng.randrange(2, 6)
        grid, top, deep = [], 50.0, rng.choice([9.0, 14.0])
        lefts = [40.0 + 100 * c for c in range(m + 1)]
        edges = [top - 6]
        for r in range(n):
            row, height = [], 1
            for c in range(m):
                empty = r > 0 and rng.random() < 0.25 and (ruled or c > 0)
                lines = 0 if empty else rng.choice([1, 1, 2, 3]) if r > 0 and (ruled or c > 0) else 1
                said = [" ".join(word() for _ in range(rng.randrange(1, 3))) for _ in range(lines)]
                for k, line in enumerate(said):
                    words += words_at(page, lefts[c] + rng.choice([2, 4]), top + 12 * k, line)
                row.append(" ".join(said) or None)
                height = max(height, lines)
            if not ruled and r > 0 and sum(x is not None for x in row) < 2:  # a line of one segment would be a wrapped one
                for c in range(m):
                    if row[c] is None:
                        row[c] = word()
                        words += words_at(page, lefts[c] + 2, top, row[c])
            grid.append(row)
            top += 12 * height + deep
            edges.append(top - 6)
        grid = [r for r in grid]
        if ruled:
            merged = m > 2 and rng.random() < 0.5
            if merged:  # the last row's second cell spans the third column
                words = [w for w in words if not (w[1] == page and edges[-2] <= w[4] < edges[-1] and w[2] >= lefts[2] and w[2] < lefts[3])]
                grid[-1][2] = None
            jitter = lambda: rng.uniform(-0.7, 0.7)
            for y in edges:
                rules += [("p", page, lefts[0], y + jitter(), lefts[1], y + jitter()), ("p", page, lefts[1] + 1.5, y + jitter(), lefts[-1], y)]
            for c, x in enumerate(lefts):
                foot = edges[-2] if merged and c == 2 else edges[-1]
                rules.append(("p", page, x + jitter(), foot, x + jitter(), edges[0]))
        planted[page] = [grid]
        if page % 3 == 0:  # prose around it, and a second table far below
            words += words_at(page, 40, top + 60, "this is a line of prose that runs on over every column " + "and on " * 8)
            second = [[word(), word()] for _ in range(3)]
            for r, row in enumerate(second):
                for c, text in enumerate(row):
                    words += words_at(page, 60 + 120.0 * c, top + 120 + 18 * r, text)
            if ruled:
                ys, xs = [top + 115 + 18 * r for r in range(4)], [55.0, 175.0, 300.0]
                rules += [("p", page, xs[0], y, xs[-1], y) for y in ys] + [("p", page, x, ys[0], x, ys[-1]) for x in xs]
            planted[page].append(second)
    rng.shuffle(words)
    rng.shuffle(rules)
    found = tables_of(spark, words, rules)
    for page, grids in planted.items():
        assert found.get(page) == grids, page


def test_awkward_pages(spark):
    cells = [(x, y, f"c{x}{y}") for x in range(2) for y in range(2)]
    words = [w for x, y, t in cells for w in words_at(0, 50.0 + 100 * x, 50.0 + 20 * y, t)]
    odd = [("p", 0, None, 1.0, 1.0, 2.0, "lost"), ("p", 0, 1.0, 2.0, 3.0, 4.0, None), ("p", 1, 1.0, 2.0, 3.0, 4.0, " "), (None, 2, 1.0, 9.0, 3.0, 13.0, "alone")]
    assert tables_of(spark, words + odd) == {0: [[["c00", "c10"], ["c01", "c11"]]]}
    assert tables_of(spark, [w for w in words if w[1] == 5]) == {}
    frame = [("p", 0, 40.0, 40.0, 240.0, 40.0), ("p", 0, 40.0, 90.0, 240.0, 90.0), ("p", 0, 40.0, 40.0, 40.0, 90.0), ("p", 0, 240.0, 40.0, 240.0, 90.0)]
    assert tables_of(spark, words, frame) == {}  # one cell is no table, but the page is ruled
    assert tables_of(spark, words, frame[:3], aligned=False) == {} and 0 in tables_of(spark, words, frame[:3])
    twice = tables_of(spark, words + words, None)
    assert twice[0][0][0][0] == "c00 c00"
    nulls = [(None, *w[1:]) for w in words]
    assert tables_of(spark, nulls)[0] == [[["c00", "c10"], ["c01", "c11"]]]  # pages without a path are a page


def test_pages_of_arrays(spark):
    """Pages whole in a row, and what they lack passed over: words, their texts and places, rules and their ends."""
    word, rule = "struct<x0:double,x1:double,top:double,bottom:double,text:string>", "struct<x0:double,y0:double,x1:double,y1:double>"
    words = [w[2:] for x in range(2) for y in range(3) for w in words_at(0, 50.0 + 100 * x, 50.0 + 20 * y, f"c{x}{y}")]
    lines = [(40.0, y, 240.0, y) for y in (45.0, 65.0, 85.0)] + [(x, 45.0, x, 85.0) for x in (40.0, 140.0, 240.0)]
    odd = [(1.0, 2.0, None, 4.0, "lost"), (1.0, 2.0, 3.0, 4.0, None), None]
    pages = [("a", words + odd, lines + [(None, 0.0, 9.0, 9.0)]), ("b", words + odd, None), ("c", words, []), ("d", None, lines), ("e", [], None), ("f", None, None)]
    found = layout.tables_of_pages(spark.createDataFrame(pages, f"path string, words array<{word}>, rules array<{rule}>"), by=("path",)).collect()
    two, all_ = [["c00", "c10"], ["c01", "c11"]], [["c00", "c10"], ["c01", "c11"], ["c02", "c12"]]
    assert {r.path: (r.table_ord, r.grid) for r in found} == {"a": (0, two), "b": (0, all_), "c": (0, all_)} | {"d": (0, [[None, None]] * 2)}


def grid_page(rows, ruled=True):
    out = "".join(say(50 + 100 * c, 500 - 20 * r, text) for r, row in enumerate(rows) for c, text in enumerate(row))
    if ruled:
        n, m = len(rows), len(rows[0])
        out += "".join(f"45 {515 - 20 * r} m {45 + 100 * m} {515 - 20 * r} l S\n" for r in range(n + 1)) + "".join(f"{45 + 100 * c} {515 - 20 * n} {0.5} {20 * n} re f\n" for c in range(m + 1))
    return out


def test_tables_of_files(spark, tmp_path):
    one, two, three = [["Name", "Amount"], ["a", "1"], ["b", "2"]], [["X", "Y", "Z"], ["p", "q", "r"]], [["k", "v"], ["w", "u"]]
    (tmp_path / "a.pdf").write_bytes(pdf(grid_page(one), say(50, 300, "only prose here"), grid_page(two, ruled=False)))
    (tmp_path / "b.pdf").write_bytes(pdf(say(50, 300, "nothing")))
    (tmp_path / "c.pdf").write_bytes(pdf(grid_page(three), grid_page(one)))
    (tmp_path / "d.pdf").write_bytes(b"broken")
    source = DocumentSource(str(tmp_path))
    got = {r.file_name: r for r in read_documents(spark, source).collect()}
    assert got["a.pdf"].tables == [one, two] and got["a.pdf"].extraction_method == "tables" and got["a.pdf"].file_ord == 0
    assert got["b.pdf"].tables == [] and got["b.pdf"].extraction_method == "text" and got["c.pdf"].tables == [three, one] and got["d.pdf"].tables == []
    own = {r.file_name: r for r in read_documents(spark, DocumentSource(str(tmp_path), decode=Decoder(tables=(lambda c: [[["o", "w"], ["n", "x"]]],)))).collect()}
    assert own["a.pdf"].tables == [[["o", "w"], ["n", "x"]]]  # a decoder's tables go before the layout's
    off = Decoder(prefer_tables=False)
    assert all(not r.tables for r in read_documents(spark, DocumentSource(str(tmp_path), decode=off)).collect())
    assert read_documents(spark, DocumentSource(str(tmp_path), decode=Decoder(prefer_tables=False, strategy="table_first"))).where(F.size("tables") > 0).count() == 2
    first = read_documents(spark, DocumentSource(f"{tmp_path}/c.pdf", decode=Decoder(max_pages=1))).first()
    assert first.tables == [three]
    ruled = {(os.path.basename(r.path), r.page_ord): r.grid for r in read_page_tables(spark, source).collect()}
    assert ruled == {("a.pdf", 0): one, ("c.pdf", 0): three, ("c.pdf", 1): one}
    assert [r.grid for r in read_page_tables(spark, source, 1).collect()] == [one]


def counting(folder):
    class Counting(pdf_text.PdfPages):
        def text(self, page):
            open(f"{folder}/{page}-{uuid.uuid4().hex}", "w").close()
            return super().text(page)

    return Counting


def test_only_the_pages_asked_for_are_decoded(spark, tmp_path):
    seen = tmp_path / "seen"
    (tmp_path / "in" / "deep").mkdir(parents=True)
    seen.mkdir()
    big = pdf(*(say(50, 300, f"page {k}") for k in range(500)))
    (tmp_path / "in" / "big.pdf").write_bytes(big)
    (tmp_path / "in" / "deep" / "small.PDF").write_bytes(pdf(say(1, 1, "small")))
    source = DocumentSource(f"{tmp_path}/in", recursive=True, decode=Decoder(paged=counting(str(seen))))
    row = read_pages(spark, source).where("page_ord = 3").first()
    assert (row.page_ord, row.n_pages, row.text) == (3, 500, "page 3") and len(os.listdir(seen)) == 1
    assert read_pages(spark, source).where("page_ord >= 497 AND page_ord < 499").count() == 2 and len(os.listdir(seen)) == 3
    assert read_pages(spark, source).where("page_ord IN (0, 7)").count() == 3 and len(os.listdir(seen)) == 6
    assert sum(r.n_pages for r in page_counts(spark, source).collect()) == 501 and len(os.listdir(seen)) == 6  # counting decodes none
    name = register_page_source(spark)
    read = spark.read.format(name).option("share", len(big) // 7).option("recursive", "true").load(f"{tmp_path}/in")
    assert read.rdd.getNumPartitions() >= 8  # several tasks for the large file, one for the small
    assert read.select("page_ord", "text").distinct().count() == 501
    assert read.where(F.col("path").endswith("PDF")).count() == 1  # a filter that Spark keeps
    path = read.where("page_ord = 9").first().path
    assert path == f"file:{tmp_path}/in/big.pdf" and read.where(F.col("path") == path).rdd.getNumPartitions() == read.rdd.getNumPartitions() - 1
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format(name).load(f"{tmp_path}/none").count()


def test_strategy_is_a_setting():
    from docrows.plans.pipeline import Pipeline

    assert Pipeline(from_dict({"extraction": {"strategy": "table_first", "prefer_tables": False}})).decoder().strategy == "table_first"
    with pytest.raises(ValueError):
        from_dict({"extraction": {"strategy": "guess"}})
