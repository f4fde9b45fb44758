"""Conversation structure repair by a bidirectional tight-arc DAG.

A conversation's edits are paths through a layered graph: a layer for each row, in it a node for each state of the automaton
of ``(s?(ua)+)?``, and arcs that keep, rerole or delete the row or insert a turn. Minimum costs from the start and to the end
tell which arcs lie on a cheapest path; a walk over those with a set of frontier states takes the least letter at each step.

The costs need a row's kind only (its role's initial and its fault), a letter. Conversations of over BLOCK rows are cut into
blocks of neighbouring rows. A block's costs are a small min-plus matrix and its walk a map of states, so the blocks of a
conversation are worked on side by side and meet only in those.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Rows of a conversation that are worked on at once.
BLOCK = 20_000
#: Conversations of over BLOCK rows that may be broadcast (of one row in BLOCK at most); more are joined by a shuffle.
FEW = 100_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Kinds of rows: the role's initial (``?``: another), as a capital where the text is cut off (``!``: another); ``x``: blank or repeated.
_SPACES = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_FAR = 1 << 60
_NONE = (_FAR,) * 4
_ACCEPT = (0, _FAR, _FAR, 0)
#: Where an assistant's or user's turn leads, from each state; None: it can't stand there.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_SYSTEM: "system", _USER: "user", _ASSISTANT: "assistant"}


def _arcs(kind: str) -> list[tuple[int, int, int, str]]:
    """State, next state, cost and letter of what can be done with a row."""
    out = [(s, s, DELETE, "D") for s in range(4)]
    if kind != "x":
        more = TRUNCATED * (kind.isupper() or kind == "!")
        initial = kind.lower()
        out += [(s, t, REROLE + more, "R") for s, t in enumerate(_NEXT)]
        out += [(s, t, KEEP + more, "K") for s, t in enumerate(_NEXT) if initial == _ROLE[t][0]]
        out += [(_START, _SYSTEM, KEEP + more, "K")] * (initial == "s")
    return out


_ARCS = {kind: _arcs(kind) for kind in "suaSUA?!x"}


def forward(kinds: str, start: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost of each state in each layer, insertions included, from ``start``'s."""
    inserted = lambda v: (v[0], v[1], u := min(v[2], min(v[0], v[1], v[3]) + INSERT), min(v[3], u + INSERT))
    layers = [inserted(start)]
    for kind in kinds:
        now, to = layers[-1], list(_NONE)
        for s, t, cost, _ in _ARCS[kind]:
            to[t] = min(to[t], now[s] + cost)
        layers.append(inserted(to))
    return layers


def backward(kinds: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost from each state in each layer to ``end``'s."""
    inserted = lambda v: (min(v[0], (u := min(v[2], v[3] + INSERT)) + INSERT), min(v[1], u + INSERT), u, min(v[3], u + INSERT))
    layers = [inserted(end)]
    for kind in reversed(kinds):
        then, to = layers[-1], list(_NONE)
        for s, t, cost, _ in _ARCS[kind]:
            to[s] = min(to[s], cost + then[t])
        layers.append(inserted(to))
    return layers[::-1]


def walk(kinds: str, start: tuple[int, ...], end: tuple[int, ...], frontier: int, last: bool) -> tuple[str, str, int]:
    """The least letters over tight arcs, the state that each leads to (as a digit) and the frontier at the end.

    ``frontier``: the state to begin in. Letters decide the state that they lead to, so a frontier never holds two. Insertions
    in the last layer are left to the next block's first layer, unless this is the ``last`` block.
    """
    f, b = forward(kinds, start), backward(kinds, end)
    total = min(x + y for x, y in zip(f[0], b[0]))
    letters, states, i, at = [], [], 0, {frontier}
    while i < len(kinds) or last:
        arcs = [(letter, t) for s, t, cost, letter in (_ARCS[kinds[i]] if i < len(kinds) else ()) if s in at and f[i][s] + cost + b[i + 1][t] == total]
        arcs += [("I", t) for s, t in enumerate(_NEXT) if s in at and f[i][s] + INSERT + b[i][t] == total]
        if i == len(kinds) and any(f[i][s] + _ACCEPT[s] == total for s in at):
            break
        least = min(letter for letter, _ in arcs)
        at = {t for letter, t in arcs if letter == least}
        letters.append(least)
        states.append(str(min(at)))
        i += least != "I"
    return "".join(letters), "".join(states), min(at)


def _solved(kinds: str, start: tuple[int, ...], end: tuple[int, ...], state: int, last: bool) -> tuple[list[str], list[int], list[str | None]]:
    """The letters, the row that each is about (-1: none) and the role that it sets, if it does."""
    letters, states, _ = walk(kinds, start, end, state, last)
    row, rows, roles = 0, [], []
    for letter, s in zip(letters, states):
        rows.append(-1 if letter == "I" else row)
        roles.append(_ROLE[int(s)] if letter in "IR" else None)
        row += letter != "I"
    return list(letters), rows, roles


def _whole(kinds: str) -> tuple[int, list[str], list[int], list[str | None]]:
    begin = (0, _FAR, _FAR, _FAR)
    return (min(x + y for x, y in zip(forward(kinds, begin)[-1], _ACCEPT)), *_solved(kinds, begin, _ACCEPT, _START, True))


@lru_cache(1 << 14)
def _short(kinds: str) -> tuple[int, list[str], list[int], list[str | None]]:
    return _whole(kinds)  # many short conversations are alike


_EDITS = "letters array<string>, rows array<int>, roles array<string>"


def _solve(kinds: pd.Series) -> pd.DataFrame:
    """All of a conversation at once."""
    return pd.DataFrame([(_short if len(k) <= 32 else _whole)(k) for k in kinds], columns=["cost", "letters", "rows", "roles"])


def _matrix(kinds: pd.Series) -> pd.Series:
    """Costs from each state before a block to each state after it, row by row."""
    units = [tuple(0 if s == t else _FAR for t in range(4)) for s in range(4)]
    return pd.Series([[min(x, _FAR) for u in units for x in forward(k, u)[-1]] for k in kinds])


def _costs(matrices: pd.Series) -> pd.Series:
    """For each of a conversation's blocks, by its matrix: the costs before it from the start, and after it to the end."""
    out = []
    for of_blocks in matrices:
        m = [np.array(x, np.int64).reshape(4, 4) for x in of_blocks]
        before, after = [np.array([0, _FAR, _FAR, _FAR])], [np.array(_ACCEPT)]
        for x in m:
            before.append(np.minimum((before[-1][:, None] + x).min(axis=0), _FAR))
        for x in reversed(m):
            after.append(np.minimum((x + after[-1][None, :]).min(axis=1), _FAR))
        cost = int((before[-1] + after[0]).min())
        out.append([{"start": b.tolist(), "end": a.tolist(), "cost": cost} for b, a in zip(before, after[-2::-1])])
    return pd.Series(out)


def _ints(values: np.ndarray) -> tuple[int, ...]:
    return tuple(map(int, values))


def _enters(exits: pd.Series) -> pd.Series:
    """The state before each of a conversation's blocks, by the states after each."""
    out = []
    for of_blocks in exits:
        at = [_START]
        for x in of_blocks[:-1]:
            at.append(int(x[at[-1]]))
        out.append(at)
    return pd.Series(out)


def _exits(kinds: pd.Series, start: pd.Series, end: pd.Series, cost: pd.Series) -> pd.Series:
    """The state after a block for each state before it; -1 for those that no cheapest path comes through."""
    out = []
    for k, f, b, total in zip(kinds, map(_ints, start), map(_ints, end), cost):
        at = [x + y for x, y in zip(forward(k, f)[0], backward(k, b)[0])]
        out.append([walk(k, f, b, s, False)[2] if at[s] == total else -1 for s in range(4)])
    return pd.Series(out)


def _solve_block(kinds: pd.Series, start: pd.Series, end: pd.Series, state: pd.Series, last: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_solved(k, _ints(f), _ints(b), int(s), bool(z)) for k, f, b, s, z in zip(kinds, start, end, state, last)], columns=["letters", "rows", "roles"])


def _kind() -> Column:
    """A row's kind from role, text and ``again`` (whether its role and text stand earlier)."""
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?")
    cut = ~F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1)).isin(".", "!", "?")
    return F.when(_blank() | F.col("again"), "x").when(cut, F.when(initial == "?", "!").otherwise(F.upper(initial))).otherwise(initial)


def _blank() -> Column:
    return ~F.col("text").rlike(WORD)


def _gathered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, the rows in order, their kinds as one text and the faults within them."""
    fault = F.when(_blank(), "blank").when(F.col("again"), "duplicate").when(F.col("kind").rlike("[A-Z!]"), "truncated")
    row = F.struct("turn", "role", "text", "place", "kind", fault.alias("fault"))
    g = rows.withColumn("kind", _kind()).groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("present"), row))).alias("r"))
    count = lambda name: F.size(F.filter("r", lambda x: x["fault"] == name)).cast("long").alias(name)
    initials = F.transform("r", lambda x: F.substring(x["role"], 1, 1))
    odd = F.zip_with(F.slice("initials", 1, F.greatest(F.size("initials") - 1, F.lit(0))), F.slice("initials", 2, F.size("initials")), lambda a, b: F.concat(a, b).isin("su", "ua", "au"))
    return g.withColumn("initials", initials).select(
        *by, "r", F.array_join(F.transform("r", lambda x: x["kind"]), "").alias("kinds"), *(count(x) for x in ("blank", "duplicate", "truncated")),
        F.size(F.filter(odd, lambda legal: ~legal)).cast("long").alias("illegal"), F.try_element_at("initials", F.lit(1)).alias("head"), F.try_element_at("initials", F.lit(-1)).alias("tail"),
    )


def _gaps(least: Column, most: Column, distinct: Column) -> Column:
    return F.coalesce(most - least + 1 - distinct, F.lit(0)).cast("long")


def _edits() -> Column:
    """The edits in order: letter, role and text of the row that they leave (of a deleted row: its own)."""
    own = lambda i: F.get("r", i)
    return F.zip_with(
        F.zip_with("rows", "roles", lambda i, role: F.struct(i.alias("i"), role.alias("role"))), "letters",
        lambda x, letter: F.struct(
            letter.alias("edit"), F.coalesce(x["role"], own(x["i"])["role"]).alias("role"),
            F.when(letter == "I", "").otherwise(own(x["i"])["text"]).alias("text"),
        ),
    )


_FAULTS = ("blank", "duplicate", "truncated", "illegal")


def repair_conversations(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Cheapest edits that give each conversation of ``rows`` (conv_id, turn, role, text) the roles ``(s?(ua)+)?``, by their initials.

    Rows are taken by turn (nulls first), ties by role and text; null roles and texts count as one space. ``copies``: how often
    a row stands there (1 unless given); with 0 it only names its conversation, which then has no edits. Rows without an id are a
    conversation of their own. Other columns are not read; no rows give no rows.

    Returns conv_id, block and blocks (1 but for conversations of over BLOCK rows, whose blocks follow each other), gaps and
    cost (the conversation's), blank, duplicate, truncated and illegal (the block's), and edits: letter (``D`` delete, ``I``
    insert, ``K`` keep, ``R`` rerole), role and text for each, those of least letters among the cheapest.
    """
    n = F.lit(1) if copies is None else copies
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n.alias("n"))
    sizes = base.groupBy("conv_id").agg(F.sum("n").alias("of")).where(F.col("of") > BLOCK)
    large = materialize(sizes.select(F.col("conv_id").alias("id")), "large")
    marked = F.broadcast(large) if large.limit(FEW + 1).count() <= FEW else large
    at = F.col("conv_id").eqNullSafe(F.col("id"))
    each = lambda d: d.withColumn("place", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1))))).withColumn("present", F.col("n") > 0)

    small = each(base.join(marked, at, "left_anti")).repartition("conv_id")
    seen = W.partitionBy("conv_id", "present", "role", "text").orderBy("turn", "place")  # within the partitions of conv_id
    small = _gathered(small.withColumn("place", F.row_number().over(seen)).withColumn("again", F.col("place") > 1), ["conv_id"])
    turns = F.array_compact(F.array_distinct(F.transform("r", lambda x: x["turn"])))
    whole = small.withColumn("s", F.pandas_udf(_solve, f"cost long, {_EDITS}")("kinds")).select("conv_id", "r", turns.alias("turns"), *_FAULTS, "s.*").select(
        "conv_id", F.lit(0).alias("block"), F.lit(1).alias("blocks"), _gaps(F.array_min("turns"), F.array_max("turns"), F.size("turns")).alias("gaps"), "cost", *_FAULTS, _edits().alias("edits")
    )
    if large.isEmpty():
        return whole
    return whole.unionByName(_repair_large(each(base.join(marked, at, "left_semi").where("n > 0"))))


def _repair_large(rows: DataFrame) -> DataFrame:
    """``repair_conversations`` of conversations of over BLOCK rows, cut by ranges of their rows."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), "large-rows")
    by = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn", "row")).alias("first"))
    told = rows.alias("r").join(first.alias("f"), by("r", "f") & (F.col("r.said") == F.col("f.said"))).select(
        "r.conv_id", "r.turn", "r.role", "r.text", F.col("r.row").alias("place"), "r.present", (F.struct("r.turn", "r.row") > F.col("f.first")).alias("again")
    )
    parts = -(-rows.count() // BLOCK)
    cut = told.repartitionByRange(parts, "conv_id", "turn", "role", "text", "place").withColumn("block", F.spark_partition_id())
    blocks = materialize(_gathered(materialize(cut, "large-cut"), ["conv_id", "block"]).withColumn("matrix", F.pandas_udf(_matrix, "array<long>")("kinds")), "large-blocks")

    # what a conversation's blocks know of each other: some numbers for each block
    known = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "matrix", "head", "tail"))).alias("b"))
    costs = known.select("conv_id", "b", F.pandas_udf(_costs, "array<struct<start: array<long>, end: array<long>, cost: long>>")(F.transform("b", lambda x: x["matrix"])).alias("c"))
    each = F.zip_with("b", "c", lambda b, c: F.struct(b["block"].alias("block"), c["start"].alias("start"), c["end"].alias("end"), c["cost"].alias("cost")))
    costs = costs.select("conv_id", F.inline(each))
    turned = materialize(
        blocks.alias("b").join(costs.alias("c"), by("b", "c") & (F.col("b.block") == F.col("c.block"))).select("b.*", "c.start", "c.end", "c.cost")
        .withColumn("exits", F.pandas_udf(_exits, "array<int>")("kinds", "start", "end", "cost")), "large-exits",
    )
    path = turned.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "exits", "head", "tail"))).alias("b"))
    seam = lambda k, x: (k > 0) & ~F.concat(F.get("b", k - 1)["tail"], x["head"]).isin("su", "ua", "au")  # noqa: E731  of a block with the one before it
    of_block = lambda x, k: F.struct(
        x["block"].alias("block"), F.get("e", k).alias("state"), F.coalesce(seam(k, x), F.lit(False)).alias("seam"), (k == F.size("b") - 1).alias("last"), k.alias("k"), F.size("b").alias("blocks")
    )
    states = path.withColumn("e", F.pandas_udf(_enters, "array<int>")(F.transform("b", lambda x: x["exits"]))).select("conv_id", F.inline(F.transform("b", of_block)))
    turns = rows.groupBy("conv_id", "turn").agg(F.count("*")).groupBy("conv_id").agg(_gaps(F.min("turn"), F.max("turn"), F.count("turn")).alias("gaps"))
    solved = turned.alias("t").join(states.alias("s"), by("t", "s") & (F.col("t.block") == F.col("s.block"))).select("t.*", "s.state", "s.seam", "s.last", "s.k", "s.blocks")
    solved = solved.withColumn("done", F.pandas_udf(_solve_block, _EDITS)("kinds", "start", "end", "state", "last")).select("*", "done.*").withColumn("edits", _edits())
    return solved.alias("x").join(turns.alias("g"), by("x", "g")).select(
        "x.conv_id", F.col("x.k").alias("block"), "x.blocks", "g.gaps", "x.cost", "x.blank", "x.duplicate", "x.truncated",
        (F.col("x.illegal") + F.col("x.seam").cast("long")).alias("illegal"), "x.edits",
    )


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by the crc32 of ``conv_id:turn`` (nulls as one space) modulo 20, and ``copies``, how often each then stands there.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's; the rest stay.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate(named("text"), ".!?", "")).otherwise(named("text"))
    return rows.select("conv_id", "turn", "role", "text", how.alias("how")).select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"),
        F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1).alias("copies"),
    )
