"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Of two lines within ``edits`` edits, one holds a segment of the other unchanged if that is cut into edits + 1 segments.
Each distinct line indexes its segments by its length, and probes the indexes of lines as long as itself or a little
shorter with the substrings that a pair's length difference allows. A line is named by 128 bits of its own hash, never by
its place, so that rows which repeat an id keep their own lines.

Index rows are aggregated by segment before they are shuffled, and a segment keeps no more than the number of its lines and
two of them. Where there are no more, these are the candidates, verified by a banded bit-parallel edit distance. A segment
with more lines is a group. Whether a line of a group has an earlier one near it is asked of a sample of the group first,
which is dealt to all parts of the group's lines; what this leaves open meets the whole group in blocks. A semi-join stops
at the first earlier line that is near, so that neither pairs nor candidates of a group are ever written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

EDITS, MIN_CHARS = 2, 20
#: Rows (of about 50 bytes) that may be broadcast.
FEW = 500_000
#: Lines of a group's sample and of its parts, and of the blocks of a group that meet the lines left open.
PART, BLOCK = 1024, 8192


def _few(df: DataFrame) -> DataFrame:
    """A written table, for a broadcast if it is small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _let(c: Column, use) -> Column:
    """``use(c)`` with c evaluated once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edits between two texts, ``b`` the shorter one by at most ``most``; any number over ``most`` may stand for more.

    A column of the distance table is kept as the signs of its differences, in as many bits as the band around the diagonal
    has rows (2 x most + 1). One step for each code point of ``b`` takes the rows that match it as bits, and moves the band
    down; the distance is followed along the band's lower edge, and along the last row when the edge has reached it.
    """
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (2 * most)

    def step(state: Column, y: Column, x: Column) -> Column:
        j, plus, minus, rows = state["j"], state["plus"], state["minus"], F.size(x)
        match = reduce(lambda u, v: u + v, (F.when(F.get(x, j + (t - most)) == y, 1 << t).otherwise(0) for t in range(width)))

        def move(eq: Column, same: Column) -> Column:
            right = minus.bitwiseOR(F.bitwise_not(same.bitwiseOR(plus)))
            left = same.bitwiseAND(plus)
            down = F.shiftrightunsigned(same.bitwiseAND(F.lit(full)), 1)
            bit = F.call_function("shiftleft", F.lit(1), rows - 1 - j + most)
            has = lambda c, m: (c.bitwiseAND(m) != 0).cast("int")
            more = F.when(j + most < rows, 1 - has(same, F.lit(top))).otherwise(has(right, bit) - has(left, bit))
            return F.struct(
                left.bitwiseOR(F.bitwise_not(down.bitwiseOR(right))).bitwiseAND(F.lit(full)).alias("plus"),
                down.bitwiseAND(right).bitwiseAND(F.lit(full)).alias("minus"), (state["d"] + more).alias("d"), (j + 1).alias("j"),
            )

        diagonal = lambda eq: (eq.bitwiseAND(plus) + plus).bitwiseXOR(plus).bitwiseOR(eq).bitwiseOR(minus)
        return _let(match, lambda eq: _let(diagonal(eq), lambda same: move(eq, same)))

    begin = F.struct(F.lit(full ^ ((1 << most) - 1)).alias("plus"), F.lit(0).alias("minus"), F.lit(most).alias("d"), F.lit(0).alias("j"))
    run = lambda z: F.aggregate(z["b"], begin, lambda s, y: step(s, y, z["a"]), lambda s: s["d"])
    return _let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), run)


def lines(docs: DataFrame, min_chars: int, short: bool = False) -> DataFrame:
    """doc_id, fp (hash of the row's text), line_no (from 0), line and its 128-bit name, of rows with an id: lines of
    ``min_chars`` code points, and with ``short`` shorter ones that hold a word."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("fp"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    long = F.length("line") >= min_chars
    return rows.where(long | F.col("line").rlike(WORD) if short else long).select("doc_id", "fp", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _segment(length: Column, i: int, edits: int, shift: int) -> Column:
    a, b = F.floor(length * i / (edits + 1)), F.floor(length * (i + 1) / (edits + 1))
    text = F.col("line").substr((a + shift + 1).cast("int"), (b - a).cast("int"))
    return F.xxhash64(length.cast("int"), F.lit(i), text)


def _index(own: DataFrame, edits: int) -> DataFrame:
    """key, lines, low, high: how many lines have a segment, and two of them by the first half of their names."""
    keys = F.array(*(_segment(F.length("line"), i, edits, 0) for i in range(edits + 1)))
    return own.select("h1", F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("lines"), F.min("h1").alias("low"), F.max("h1").alias("high"))


def _probes(own: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Substrings that can be a segment of a line ``less`` code points shorter, where both sides' edits are counted; the line's own segments first."""
    n, own_keys, out = F.length("line"), [], []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                key = _segment(n - less, i, edits, shift)
                (out if less or shift else own_keys).append(F.when(n - less >= min_chars, key) if less else key)
    found = own.select("h1", F.posexplode(F.array(*own_keys, *out)).alias("place", "key")).where("key IS NOT NULL")
    return found.select("h1", F.col("key").alias("p_key"), (F.col("place") <= edits).alias("own"))


def _letters(line: Column) -> Column:
    """Which of 64 classes of code points are odd in number: an edit changes two at most."""
    add = lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), add)


def _near(edits: int) -> Column:
    """Whether line b of a group stands before line a and is near to it. The cheap tests come first."""
    earlier = F.struct("b_doc", "b_line") < F.struct("a_doc", "a_line")
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2 * edits
    size = F.abs(F.length("a_text") - F.length("b_text")) <= edits
    return earlier & alike & size & (F.levenshtein("a_text", "b_text", edits) >= 0)  # -1 beyond the threshold


def _side(c: str, rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("h1").alias(f"{c}_h1"), F.col("h2").alias(f"{c}_h2"), F.col("doc_id").alias(f"{c}_doc"), F.col("line_no").alias(f"{c}_line"), F.col("line").alias(f"{c}_text"), F.col("letters").alias(f"{c}_letters"))


def _have_earlier(late: DataFrame, early: DataFrame, edits: int) -> DataFrame:
    """h1, h2 of the rows of ``late`` for which ``early`` has an earlier near line in the same group.

    Both sides of a group are cut into parts and blocks of bounded size; each part meets each block in a key of its own.
    """
    count = lambda rows, name: rows.groupBy("key").agg(F.count("*").alias(name))
    cuts = lambda name, size: F.ceil(F.col(name) / F.lit(size)).cast("int")
    size = count(late, "late").join(count(early, "early"), "key").select("key", cuts("late", PART).alias("parts"), cuts("early", BLOCK).alias("blocks"))
    size = _few(materialize(size, "group-sizes"))
    place = lambda c, n: F.pmod(F.xxhash64(F.lit("place"), f"{c}_h1", f"{c}_h2"), n)
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = _side("a", late).join(size, "key").withColumn("part", place("a", "parts")).withColumn("block", deal("blocks")).drop("parts", "blocks")
    b = _side("b", early).join(size, "key").withColumn("block", place("b", "blocks")).withColumn("part", deal("parts"))
    b = b.select(*(F.col(c).alias(c if c.startswith("b_") else f"b_{c}") for c in b.columns if c not in ("parts", "blocks", "b_h1", "b_h2")))
    same = (F.col("key") == F.col("b_key")) & (F.col("part") == F.col("b_part")) & (F.col("block") == F.col("b_block"))
    return a.join(b, same & _near(edits), "left_semi").select(F.col("a_h1").alias("h1"), F.col("a_h2").alias("h2")).distinct()


def _without(rows: DataFrame, names: DataFrame) -> DataFrame:
    gone = _few(names.withColumnsRenamed({"h1": "g1", "h2": "g2"}))
    return rows.join(gone, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_anti")


def late_in_groups(group: DataFrame, text: DataFrame, edits: int) -> DataFrame:
    """h1, h2 of lines that have an earlier near one in a group. ``group``: key, own, h1, lines (how many own it).

    A sample of each group's owners comes first: in a family of near lines it settles most. The others meet all owners,
    and the owners among them all lines that share the segment without owning it.
    """
    members = materialize(group.distinct().join(text.withColumn("letters", _letters(F.col("line"))), "h1"), "members")
    sample = members.where("own").where(F.pmod(F.xxhash64(F.lit("sample"), "h1", "h2"), "lines") < PART)
    found = materialize(_have_earlier(members, sample, edits), "late")
    left = materialize(_without(members.where((F.col("lines") > PART) | F.col("own")), found), "left")
    more = _have_earlier(left.where(F.col("lines") > PART), members.where("own"), edits).unionByName(_have_earlier(left.where("own"), members.where("NOT own"), edits))
    return found.unionByName(materialize(more, "late"))


def near_lines(docs: DataFrame, edits: int, min_chars: int, short: bool = False) -> DataFrame:
    """h1, h2, first_doc, first_line of each line that has to go somewhere: its own first place if only later repeats go, or nulls if all do."""
    every = lines(docs, min_chars, short)
    repeated = (
        every.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"))
        .where("times > 1").select("h1", "h2", "first")
    )
    repeated = materialize(repeated, "repeated")
    own = every.where(F.length("line") >= min_chars).join(_few(repeated), ["h1", "h2"], "left").where("first IS NULL OR first = struct(doc_id, line_no)").select("doc_id", "line_no", "line", "h1", "h2")

    met = _probes(own, edits, min_chars).join(_index(own, edits), F.col("p_key") == F.col("key")).where("NOT own OR lines > 1")
    met = materialize(met.drop("p_key"), "met")
    pairs = met.where("lines <= 2").select(F.col("h1").alias("a1"), F.explode(F.array("low", "high")).alias("b1")).where("a1 <> b1")
    pairs = materialize(pairs.select(F.greatest("a1", "b1").alias("a1"), F.least("a1", "b1").alias("b1")).distinct(), "pairs")
    group = materialize(met.where("lines > 2").select("key", "own", "h1", "lines"), "group")
    ends = pairs.select(F.explode(F.array("a1", "b1")).alias("e1")).unionByName(group.select(F.col("h1").alias("e1")))
    text = materialize(own.join(_few(materialize(ends.distinct(), "ends")), F.col("h1") == F.col("e1"), "left_semi"), "near-texts")

    side = lambda c: text.select(F.col("h1").alias(f"{c}1"), *(F.struct("doc_id", "line_no").alias(f"{c}_place"), F.struct("h1", "h2").alias(f"{c}_name"), F.col("line").alias(f"{c}_text")))
    both = pairs.join(side("a"), "a1").join(side("b"), "b1").where("a_place <> b_place").where(F.abs(F.length("a_text") - F.length("b_text")) <= edits)
    longer = F.length("a_text") >= F.length("b_text")
    distance = banded_distance(F.when(longer, F.col("a_text")).otherwise(F.col("b_text")), F.when(longer, F.col("b_text")).otherwise(F.col("a_text")), edits)
    late = both.where(distance <= edits).select(F.when(F.col("a_place") > F.col("b_place"), F.col("a_name")).otherwise(F.col("b_name")).alias("x")).select("x.h1", "x.h2")
    late = materialize(late, "late-pairs")
    if group.limit(1).count():
        late = late.unionByName(late_in_groups(group, text, edits))
    late = materialize(late.distinct(), "late")
    return (
        _without(repeated, late).select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))
        .unionByName(late.select("h1", "h2", F.lit(None).cast("long").alias("first_doc"), F.lit(None).cast("int").alias("first_line")))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, short_exact: bool = False) -> DataFrame:
    """``docs`` with n_lines, removed (sorted array of line numbers from 0) and kept_text.

    A line is removed if it, or a line within ``edits`` edits of it, stands earlier: in a document with a smaller id, or
    further up. Lines are judged on the input, not on what is left; they end at newlines and are compared as they are.
    Lines of fewer than ``min_chars`` code points are left alone; with ``short_exact`` those that hold a word are removed if
    the very same line stands earlier. A null text stays null and has no lines, as has an empty one. Rows without an id keep
    all lines and take none from others. Of rows that repeat an id each keeps its own lines: lines in the same place of
    such rows are not earlier than one another. Ids are whole numbers, or are cast to them; text that is none counts as
    no id. Columns of ``docs`` with these three names are replaced.
    """
    docs = docs.drop("n_lines", "removed", "kept_text")
    rows = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].alias("text"))
    later = "first_doc IS NULL OR struct(first_doc, first_line) < struct(doc_id, line_no)"
    firsts = materialize(near_lines(rows, edits, min_chars, short_exact), "firsts")  # edits would join unlike short lines, so only equal ones meet
    gone = lines(rows, min_chars, short_exact).join(_few(firsts), ["h1", "h2"]).where(later)
    gone = gone.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    gone = materialize(gone.withColumnsRenamed({"doc_id": "__id", "fp": "__fp"}), "removed")
    out = docs.join(_few(gone), (docs[id_col].try_cast("long") == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__fp")), "left").drop("__id", "__fp")
    out = out.withColumn("__lines", F.split(text_col, "\n"))  # a column of its own, so that no line splits the text again
    text = F.col("__lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(text) - 1), "removed"), lambda i: F.get(text, i))
    return (
        out.withColumn("n_lines", F.when(F.length(text_col) > 0, F.size(text)).otherwise(0).cast("long"))
        .withColumn("kept_text", F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .withColumn("removed", F.coalesce("removed", F.array().cast("array<int>"))).drop("__lines")
    )
