"""Cell grids from a page's geometry: positioned words, and ruled lines where there are any.

Words are structs of x0, x1, top, bottom (points, y downwards) and text; rules are structs of x0, y0, x1, y1. A page's are two
arrays, brought together by one shuffle at most; each step is a function of these arrays, so that nothing is sorted or sent
between them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import clean_table, filter_tables
from ..functions.text import let

PAGE = ("path", "page_ord")
WORD, RULE = ("x0", "x1", "top", "bottom", "text"), ("x0", "y0", "x1", "y1")
#: Lines and words within so many points stand at the same place or meet.
TOLERANCE = 3.0
#: In a line of text, a gap of so many characters ends a cell; between lines, one of so many line heights ends a table.
CELL_GAP, TABLE_GAP = 1.6, 2.0


def _each(xs: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of each element, an array, one after the other."""
    return F.flatten(F.transform(xs, use))


def _some(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def _fields(x: Column, *names: str) -> Column:
    return F.struct(*(x[n].alias(n) for n in names))


def _in_order(xs: Column, *names: str) -> Column:
    """The elements with these fields alone, by these fields."""
    return F.sort_array(F.transform(xs, lambda x: _fields(x, *names)))


def _cut(xs: Column, starts: Column) -> Column:
    """An array in pieces that begin at these places, which are counted from 0."""
    return let(starts, lambda at: F.transform(at, lambda s, k: F.slice(xs, s + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - s)))


def _groups(xs: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """Neighbours in pieces; ``begins`` tells of an element and the next one whether a piece begins with that."""
    return let(xs, lambda xs: _cut(xs, _some(F.transform(xs, lambda x, i: F.when((i == 0) | begins(F.get(xs, i - 1), x), i)))))


def _clusters(xs: Column, at: str, apart: float = TOLERANCE) -> Column:
    """Elements in the order of ``at`` in pieces of those that follow each other closely."""
    return _groups(xs, lambda a, b: b[at] - a[at] > apart)


def _runs(xs: Column, low: str, high: str, apart: Column | float = 0.0) -> Column:
    """Intervals by where they begin, in pieces of those that overlap, directly or by others between them, or stand at most ``apart``."""
    far = lambda b, reach: b[low] - reach > apart
    begins = lambda xs, x, i: far(x, F.get(xs, i - 1)[high]) & far(x, F.array_max(F.slice(xs[high], F.lit(1), i)))  # noqa: E731 - all before are looked at only where the last one is far
    return let(xs, lambda xs: _cut(xs, _some(F.transform(xs, lambda x, i: F.when((i == 0) | begins(xs, x, i), i)))))


def joined_rules(rules: Column, flat: bool) -> Column:
    """Horizontal (``flat``) or vertical lines snapped to common places and joined: place, low, high, by place and low."""
    dx, dy = (lambda r: F.abs(r["x1"] - r["x0"])), (lambda r: F.abs(r["y1"] - r["y0"]))
    along, aside = (("x0", "x1"), ("y0", "y1")) if flat else (("y0", "y1"), ("x0", "x1"))
    own = F.filter(rules, lambda r: ((dx(r) >= dy(r)) & (dx(r) >= TOLERANCE)) if flat else ((dx(r) < dy(r)) & (dy(r) >= TOLERANCE)))
    ends = lambda r: F.struct(((r[aside[0]] + r[aside[1]]) / 2).alias("place"), F.least(*(r[c] for c in along)).alias("low"), F.greatest(*(r[c] for c in along)).alias("high"))
    line = lambda place: lambda part: F.struct(place.alias("place"), F.get(part, F.lit(0))["low"].alias("low"), F.array_max(part["high"]).alias("high"))
    joined = lambda k: let(_mean(k["place"]), lambda place: F.transform(_runs(_in_order(k, "low", "high"), "low", "high", TOLERANCE), line(place)))
    return _each(_clusters(F.sort_array(F.transform(own, ends)), "place"), lambda k: F.when(F.size(k) == 1, k).otherwise(joined(k)))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _near(at: Column, line: Column) -> Column:
    return (at >= line["low"] - TOLERANCE) & (at <= line["high"] + TOLERANCE)


def _meet(h: Column, v: Column) -> Column:
    return _near(h["place"], v) & _near(v["place"], h)


def crossings(h: Column, v: Column) -> Column:
    """For each of the lines ``h``, the numbers of the lines ``v`` that cross it and go on beyond it."""
    crosses = lambda a, b: (b["high"] > a["place"] + TOLERANCE) & _meet(a, b)
    return let(v, lambda v: F.transform(h, lambda a: _some(F.transform(v, lambda b, j: F.when(crosses(a, b), j)))))


def ruled_cells(h: Column, v: Column, downwards: Column, rightwards: Column) -> Column:
    """The rectangles that horizontal and vertical lines enclose: x0, x1, y0, y1; merged cells stand where they begin.

    From a corner, a cell's top side ends at the next crossing that has a line downwards, its left side at the next one that
    has a line to the right; it is a cell if lines close it there.
    """

    def cell(of: Column, top: Column, i: Column, j: Column, after: Column) -> Column:
        left, below = F.get(of["v"], j), F.get(F.filter(F.get(of["rightwards"], j), lambda k: k > i), F.lit(0))
        sides = F.struct(left.alias("left"), F.get(of["v"], after).alias("right"), F.get(of["h"], below).alias("foot"))
        return F.when(top["high"] > left["place"] + TOLERANCE, let(sides, lambda s: closed(top, s["left"], s["right"], s["foot"])))

    def closed(top: Column, left: Column, right: Column, foot: Column) -> Column:
        shut = _meet(foot, right) & (foot["low"] < right["place"] - TOLERANCE) & (right["low"] < foot["place"] - TOLERANCE)
        return F.when(shut, F.struct(left["place"].alias("x0"), right["place"].alias("x1"), top["place"].alias("y0"), foot["place"].alias("y1")))

    along = lambda of, top, i, js: _some(F.transform(js, lambda j, n: cell(of, top, i, j, F.get(js, n + 1))))
    known = F.struct(h.alias("h"), v.alias("v"), downwards.alias("downwards"), rightwards.alias("rightwards"))
    return let(known, lambda of: F.flatten(F.transform(of["h"], lambda top, i: let(F.get(of["downwards"], i), lambda js: along(of, top, i, js)))))


def touching_cells(cells: Column) -> Column:
    """Tables, which are cells that touch."""
    down = lambda cs: _runs(_in_order(cs, "y0", "y1", "x0", "x1"), "y0", "y1")
    along = lambda cs: _runs(_in_order(cs, "x0", "x1", "y0", "y1"), "x0", "x1")
    return _each(down(cells), along)


def ruled_grids(words: Column, tables: Column) -> Column:
    """Grids of the cells of tables. A word is in the cell that its middle is in."""
    middle = lambda w: F.struct(((w["top"] + w["bottom"]) / 2).alias("y"), w["x0"].alias("x0"), w["text"].alias("text"), ((w["x0"] + w["x1"]) / 2).alias("x"))
    text = lambda line: F.array_join(_in_order(line, "x0", "text")["text"], " ")
    level = lambda ws: F.get(ws, F.lit(0))["y"] == F.element_at(ws, -1)["y"]
    held = lambda ws: F.when(F.size(ws) > 0, F.when(level(ws), F.array_join(ws["text"], " ")).otherwise(F.array_join(F.transform(_clusters(ws, "y"), text), "\n")))

    def grid(table: Column, ws: Column) -> Column:
        ends = F.struct(F.sort_array(F.array_distinct(table["x0"])).alias("columns"), F.array_min(table["x0"]).alias("x0"), F.array_max(table["x1"]).alias("x1"))
        rows = _groups(_in_order(table, "y0", "x0", "x1", "y1"), lambda a, b: b["y0"] > a["y0"])
        own = lambda at: F.filter(ws, lambda w: (w["x"] >= at["x0"]) & (w["x"] < at["x1"]))
        return let(ends, lambda at: let(own(at), lambda ws: F.transform(rows, lambda row: filled(row, at["columns"], ws))))

    def filled(row: Column, columns: Column, ws: Column) -> Column:
        sides = F.struct(F.get(row, F.lit(0))["y0"].alias("y0"), F.array_max(row["y1"]).alias("y1"))
        beside = let(sides, lambda at: F.filter(ws, lambda w: (w["y"] >= at["y0"]) & (w["y"] < at["y1"])))
        within = lambda c, ws: F.filter(ws, lambda w: (w["x"] >= c["x0"]) & (w["x"] < c["x1"]) & (w["y"] < c["y1"]))
        return let(beside, lambda ws: F.transform(columns, lambda x: let(F.get(F.filter(row, lambda c: c["x0"] == x), F.lit(0)), lambda c: let(within(c, ws), held))))

    return let(F.sort_array(F.transform(words, middle)), lambda ws: F.transform(tables, lambda t: grid(t, ws)))


def text_lines(words: Column) -> Column:
    """Lines of words from above: top, bottom and segs, the words that stand close in it (x0, x1, text)."""
    total = lambda ws, of: F.aggregate(ws, F.lit(0.0), lambda a, w: a + of(w))
    gap = lambda ws: CELL_GAP * F.try_divide(total(ws, lambda w: w["x1"] - w["x0"]), total(ws, lambda w: F.length(w["text"])))
    placed = lambda ws, y: F.sort_array(F.transform(ws, lambda w: F.struct(y(w).alias("y"), *(w[c].alias(c) for c in ("x0", "text", "x1", "top", "bottom")))))
    first = lambda ws: F.get(ws, F.lit(0))
    along = lambda ws: F.when(first(ws)["y"] == F.element_at(ws, -1)["y"], ws).otherwise(placed(ws, lambda w: F.lit(0.0)))  # noqa: E731 - by x0 already if all stand at one height
    seg = lambda s: F.struct(first(s)["x0"].alias("x0"), F.array_max(s["x1"]).alias("x1"), F.array_join(s["text"], " ").alias("text"))
    line = lambda gap: lambda ws: F.struct(F.array_min(ws["top"]).alias("top"), F.array_max(ws["bottom"]).alias("bottom"), F.transform(_runs(along(ws), "x0", "x1", gap), seg).alias("segs"))
    return let(F.filter(words, lambda w: F.trim(w["text"]) != ""), lambda ws: let(gap(ws), lambda gap: F.transform(_clusters(placed(ws, lambda w: (w["top"] + w["bottom"]) / 2), "y"), line(gap))))


def _many(line: Column) -> Column:
    return F.size(line["segs"]) > 1


def _spans(lines: Column) -> Column:
    """Stretches that segments of the lines cover without a gap: low, high."""
    return F.transform(_runs(F.sort_array(F.flatten(lines["segs"])), "x0", "x1"), lambda s: F.struct(F.get(s, F.lit(0))["x0"].alias("low"), F.array_max(s["x1"]).alias("high")))


def spaced_lines(lines: Column) -> Column:
    """Lines in pieces that wide spaces part: space (to those above), height, segs."""
    space = lambda line, foots, i: line["top"] - F.array_max(F.slice(foots, F.lit(1), i))
    spaced = lambda lines: let(lines["bottom"], lambda foots: F.transform(lines, lambda x, i: F.struct(space(x, foots, i).alias("space"), (x["bottom"] - x["top"]).alias("height"), x["segs"].alias("segs"))))
    return _groups(let(lines, spaced), lambda a, b: b["space"] > TABLE_GAP * b["height"])


def aligned_parts(run: Column) -> Column:
    """Lines without wide spaces in pieces that lines of one segment end where this doesn't stand in a column; such lines go, and those before the first line of several."""
    crosses = lambda s, spans: F.size(F.filter(spans, lambda c: (c["low"] < s["x1"]) & (c["high"] > s["x0"]))) != 1
    ends = lambda x, spans: ~_many(x) & crosses(F.get(x["segs"], F.lit(0)), spans)
    told = let(_spans(F.filter(run, _many)), lambda spans: F.transform(run, lambda x: F.struct(x["space"].alias("space"), x["segs"].alias("segs"), ends(x, spans).alias("ends"))))
    head = lambda part: F.array_position(F.transform(part, _many), F.lit(True)).cast("int")
    from_head = lambda part: let(head(part), lambda at: F.when(at > 0, F.slice(part, at, F.size(part))))
    return _some(F.transform(_groups(told, lambda a, b: b["ends"]), lambda part: let(F.filter(part, lambda x: ~x["ends"]), from_head)))


def told_lines(part: Column, columns: Column) -> Column:
    """Lines of a table: space, cells (col, text), body (below the first line), partial (a column is empty there), indented (the first one is)."""
    col = lambda s: F.size(F.filter(columns, lambda c: c["low"] <= s["x0"])) - 1
    cells = lambda x: F.transform(x["segs"], lambda s: F.struct(col(s).alias("col"), s["text"].alias("text")))
    partial = lambda c, i: (i > 0) & (F.size(F.array_distinct(c["col"])) < F.size(columns))
    told = lambda x, i: let(cells(x), lambda c: F.struct(x["space"].alias("space"), c.alias("cells"), (i > 0).alias("body"), partial(c, i).alias("partial"), (F.array_min(c["col"]) > 0).alias("indented")))
    return F.transform(part, told)


def aligned_grid(lines: Column, width: Column) -> Column:
    """The grid of a table's lines.

    A line that leaves a column empty continues the row above where lines stand closer there than those of whole rows do, or,
    in a table of even spacing, where it leaves the first column empty.
    """
    whole = F.array_min(F.filter(lines, lambda x: x["body"] & ~x["partial"])["space"])
    close = lambda x, whole: F.coalesce(x["partial"] & (x["space"] < 0.75 * whole), F.lit(False))
    spacing = let(whole, lambda whole: F.struct(whole.alias("whole"), F.exists(lines, lambda x: close(x, whole)).alias("spaced")))
    goes_on = lambda x, s: x["partial"] & F.when(s["spaced"], close(x, s["whole"])).otherwise(x["indented"])
    said = lambda x, c: F.array_join(F.filter(x["cells"], lambda s: s["col"] == c)["text"], " ")
    text = lambda row, c: let(F.filter(F.transform(row, lambda x: said(x, c)), lambda x: x != ""), lambda ls: F.when(F.size(ls) > 0, F.array_join(ls, "\n")))
    return let(spacing, lambda s: F.transform(_groups(lines, lambda a, b: ~goes_on(b, s)), lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda c: text(r, c))))


def with_ruled_tables(pages: DataFrame) -> DataFrame:
    """Adds ``ruled``, the grids that ``rules`` draw around ``words``; null on pages without ruled cells. A step a column, as functions within functions take Spark long to resolve."""
    p = pages.withColumn("h", joined_rules(F.col("rules"), True)).withColumn("v", joined_rules(F.col("rules"), False))
    p = p.withColumn("downwards", crossings(F.col("h"), F.col("v"))).withColumn("rightwards", crossings(F.col("v"), F.col("h")))
    p = p.withColumn("cells", ruled_cells(*map(F.col, ("h", "v", "downwards", "rightwards"))))
    p = p.withColumn("ruled", F.when(F.size("cells") > 0, touching_cells(F.col("cells"))))  # tables above each other, beside each other, and so once more within those
    return p.withColumn("ruled", _each(F.col("ruled"), touching_cells)).withColumn("ruled", ruled_grids(F.col("words"), F.col("ruled"))).select(*pages.columns, "ruled")


def with_aligned_tables(pages: DataFrame, words: Column) -> DataFrame:
    """Adds ``aligned``, the grids of aligned text, by the same steps.

    Lines of two or more segments make tables, whose columns are parted by gaps that no segment of such a line crosses. A line
    of one segment that stands in a column belongs to the table; one that crosses a gap ends it, and so does a wide space.
    """
    p = pages.withColumn("lines", text_lines(words)).withColumn("aligned", spaced_lines(F.col("lines"))).withColumn("aligned", _each(F.col("aligned"), aligned_parts))
    p = p.withColumn("aligned", F.filter(F.transform("aligned", lambda t: F.struct(t.alias("lines"), _spans(t).alias("columns"))), lambda t: F.size(t["columns"]) >= 2))
    p = p.withColumn("aligned", F.transform("aligned", lambda t: F.struct(told_lines(t["lines"], t["columns"]).alias("lines"), F.size(t["columns"]).alias("width"))))
    return p.withColumn("aligned", F.transform("aligned", lambda t: aligned_grid(t["lines"], t["width"]))).select(*pages.columns, "aligned")


def tables_of_pages(pages: DataFrame, by: tuple[str, ...] = PAGE, aligned: bool = True) -> DataFrame:
    """``by``, table_ord, grid from rows of whole pages: arrays ``words`` and, where they are known, ``rules``; else as find_tables."""
    tables = []
    pages = pages.withColumn("words", F.filter("words", lambda w: reduce(Column.__and__, (w[c].isNotNull() for c in WORD))))
    if "rules" in pages.columns:
        pages = with_ruled_tables(pages)
        tables.append(F.col("ruled"))
    if aligned:
        pages = with_aligned_tables(pages, F.when(F.col("ruled").isNull(), F.col("words")) if tables else F.col("words"))
        tables.append(F.col("aligned"))
    pages = pages.withColumn("tables", F.transform(F.coalesce(*tables), lambda t: clean_table(t)))
    # outer, as a filter on how many there are would have them found twice
    return pages.select(*by, F.posexplode_outer("tables").alias("table_ord", "grid")).where("grid IS NOT NULL")


def find_tables(words: DataFrame, rules: DataFrame | None = None, by: tuple[str, ...] = PAGE, aligned: bool = True) -> DataFrame:
    """``by``, table_ord, grid for the tables of each page, cells clean and grids of two rows and columns at least.

    ``by`` names the columns that tell pages apart. Pages with ruled cells have the tables of those; others, if ``aligned``,
    those of their aligned text. Words without text or place are passed over; words that repeat are repeated in their cell. No words give no tables.
    """
    struct = lambda names: F.struct(*(F.col(c).cast("string" if c == "text" else "double").alias(c) for c in names))
    words = words.select(*by, struct(WORD).alias("word"))
    lists = [F.collect_list("word").alias("words")]
    if rules is not None:
        words = words.unionByName(rules.select(*by, struct(RULE).alias("rule")), allowMissingColumns=True)
        lists.append(F.collect_list("rule").alias("rules"))
    return tables_of_pages(words.groupBy(*by).agg(*lists), by, aligned)


def document_tables(found: DataFrame, by: str = "path", page: str = "page_ord") -> DataFrame:
    """path, tables: the grids of each document by page and place, without those of under two filled rows."""
    tables = F.transform(F.array_sort(F.collect_list(F.struct(page, "table_ord", "grid"))), lambda t: t["grid"])
    return found.groupBy(by).agg(tables.alias("tables")).withColumn("tables", filter_tables(F.col("tables")))
