"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles. Each of several independent trees sends it down a path of minwise tokens; two
documents with Jaccard similarity s take the same branch with probability s. A node that is small is compared
exhaustively, on sketches first; a larger one branches again. What the sketches don't rule out is confirmed on the full
sets, and confirmed links are joined into components. At the threshold of 0.8, a pair that must share four tokens is met
with probability 0.41 in a tree, and so with 0.995 in ten trees; most nodes are small after two or three tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, fixed64, materialize, mix, span_hash
from .components import components

TREES, DEPTH, FIRST = 10, 9, 2
#: Minwise values of a document, of which each tree takes DEPTH tokens of its own before it goes on with the others'.
VALUES, DEEPEST = 96, 40
#: A node of so many documents is compared exhaustively; one of over MOST branches before it goes to a task.
SMALL, MOST = 64, 20_000
#: Ids that may be broadcast, 8 bytes each; more are joined by a shuffle.
FEW = 2_000_000
_MULTIPLIERS = fixed64(VALUES, 3) | np.uint64(1)
_NODE = "tree int, depth int, node long, doc_id long, n long, label long, sketch binary"
#: Candidates for each row of a node from which on the node is a crowd; values of a set from which on it is thinned.
CROWD, THIN = 4, 1024
#: Rows of a crowd that meet in a task: those of a block, and those of other labels than most that are compared with them.
BLOCK, PART = 2048, 512


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row << 48 | 48 bits of the shingle's hash), sorted, each once; and the size of each row's set. At most 65,536 rows.

    A set holds each k consecutive words; of fewer words it holds the whole sequence, of none nothing.
    """
    t = texts.lower_ascii().words()
    words, many = t.hashes(), np.diff(t.first)
    rows = np.arange(len(many))
    of = np.repeat(rows, many)
    at = np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :]) if len(of) >= k else np.zeros(0, np.int64)
    short = np.flatnonzero((many > 0) & (many < k))
    starts, ends = np.r_[at, t.first[short]], np.r_[at + k, t.first[short + 1]]
    code = (span_hash(words, starts, ends) >> np.uint64(16)) | (np.r_[of[at], short].astype(np.uint64) << np.uint64(48))
    code = np.unique(code)
    return code, np.bincount((code >> np.uint64(48)).astype(np.int64), minlength=len(many))


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for part in chunks(batch, text):
        for a in range(0, part.num_rows, 1 << 15):
            yield part.slice(a, 1 << 15)


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Set size, a 128-bit name of the set, and its minwise values."""
    for batch in batches:
        for part in _slices(batch, "text"):
            code, n = shingle_sets(Texts(part.column("text")), k)
            full = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[full]
            item = mix(code << np.uint64(16))
            least = np.zeros((part.num_rows, VALUES), np.uint32)
            names = np.zeros((part.num_rows, 2), np.uint64)
            if len(full):
                for j, m in enumerate(_MULTIPLIERS):
                    least[full, j] = np.minimum.reduceat(((item * m) >> np.uint64(32)).astype(np.uint32), begin)
                names[full, 0] = np.add.reduceat(item, begin)
                names[full, 1] = np.bitwise_xor.reduceat(mix(item), begin)
            signs = pa.array([x.tobytes() for x in least], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(names[:, 0].view(np.int64)), pa.array(names[:, 1].view(np.int64)), signs],
                ["doc_id", "n", "name1", "name2", "least"])


def _paths(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Each document's node after the first tokens, in each tree; the sketch has a byte of each minwise value."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            least = np.frombuffer(b"".join(part.column("least").to_pylist()), np.uint32).reshape(-1, VALUES)
            for tree in range(trees):
                own = least[:, tree * DEPTH : (tree + 1) * DEPTH]
                node = np.full(len(least), tree + 1, np.uint64)
                for level in range(FIRST):
                    node = mix(node * np.uint64(0x9E3779B97F4A7C15) + own[:, level])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(least), tree, np.int32)), pa.array(np.full(len(least), FIRST, np.int32)), pa.array(node.view(np.int64)), part.column("doc_id"),
                     part.column("n"), part.column("label"), pa.array([x.tobytes() for x in least.astype(np.uint8)], pa.binary())],
                    ["tree", "depth", "node", "doc_id", "n", "label", "sketch"])


class _Forest:
    """Groups of rows, joined pair by pair."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flat(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return self.up
            self.up = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs joined two groups."""
        up, new = self.up, np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
                new[k] = True
        return new


def least_matches(similarity: float, sds: float = 3.8) -> int:
    """Equal sketch bytes that a pair at the threshold has but with a probability under 1e-4."""
    return int(VALUES * similarity - sds * (VALUES * similarity * (1 - similarity)) ** 0.5)


def compare(node: np.ndarray, tree: np.ndarray, depth: np.ndarray, n: np.ndarray, label: np.ndarray, sketch: np.ndarray, similarity: float, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs among rows that share a node and not a label; rows of crowds, and the node of each.

    ``forest``: of each node's candidates, only those that join two of its groups, the most alike ones first; of rows that
    are alike in all tokens, those with the first of its kind. Otherwise nodes with too many candidates are crowds, and so
    are nodes that no token splits: the rows that are in one of them are named instead.
    """
    weak, found = least_matches(similarity), []

    def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Note the candidates among pairs, and return their second rows."""
        new = len(found)
        ok = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
        a, b = a[ok], b[ok]
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            same = (sketch[x] == sketch[y]).sum(axis=1)
            found.append(np.stack([x, y, same])[:, same >= weak])
        return np.concatenate([f[1] for f in found[new:]]) if len(found) > new else b[:0]

    key, depth, most = node.copy(), depth.copy(), SMALL if forest else 2 * SMALL
    while True:  # branch by the next token wherever a node has too many pairs to compare
        order = np.lexsort((label, key))
        new_key = np.r_[True, key[order][1:] != key[order][:-1]]
        begin = np.flatnonzero(new_key)
        many = np.diff(np.r_[begin, len(key)])
        alike = np.flatnonzero(new_key | np.r_[True, label[order][1:] != label[order][:-1]])  # runs of a label in a node
        size = np.diff(np.r_[alike, len(key)])
        pairs = many * many - np.add.reduceat(size * size, np.searchsorted(alike, begin))
        wide = pairs > many * most
        large = order[np.repeat(wide, many)]
        large = large[depth[large] < DEEPEST]
        if not len(large):
            break
        key[large] = mix(key[large] * np.uint64(0x9E3779B97F4A7C15) + sketch[large, (tree[large] * DEPTH + depth[large]) % VALUES])
        depth[large] += 1
    few = ~wide & (many <= most + 1)
    small, place = np.repeat(few, many), np.arange(len(order)) - np.repeat(begin, many)
    for shift in range(1, int(many[few].max(initial=1))):
        a = np.flatnonzero(small[:-shift] & (place[shift:] >= shift))
        look(order[a], order[a + shift])
    for b, m in zip(begin[~few & ~wide], many[~few & ~wide]):  # one label has most rows: all others with every row
        rows = order[b : b + m]
        names, counts = np.unique(label[rows], return_counts=True)
        others = np.flatnonzero(label[rows] != names[counts.argmax()])
        for k in others.tolist():
            rest = np.r_[rows[:k][label[rows[:k]] == names[counts.argmax()]], rows[k + 1 :]]
            look(np.full(len(rest), rows[k]), rest)
    groups = _Forest(len(order))
    alike = [order[b : b + m] for b, m in zip(begin[wide], many[wide])]  # alike in all tokens
    for rows in alike if forest else ():
        left, head = np.arange(1, len(rows)), 0
        while len(left):
            near = np.isin(rows[left], look(np.full(len(left), rows[head]), rows[left])) | (label[rows[left]] == label[rows[head]])
            rest = left[~near]
            head, left = (rest[0], rest[1:]) if len(rest) else (0, rest)
    stuck = np.concatenate([np.zeros(0, np.int64), *(() if forest else alike)])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), stuck, key[stuck]
    x, y, same = np.concatenate(found, axis=1)
    if not forest:
        at = np.searchsorted(key[order][begin], key[x])
        crowd = (np.bincount(at, minlength=len(begin)) > CROWD * many)[at]
        rows = np.unique(np.r_[x[crowd], y[crowd], stuck])
        return x[~crowd], y[~crowd], rows, key[rows]
    out = []
    for level in np.unique(same)[::-1]:
        group = groups.flat()
        k = np.flatnonzero((same == level) & (group[x] != group[y]))
        k = k[groups.join(x[k], y[k])]
        out.append(k)
    out = np.concatenate(out)
    return x[out], y[out], out[:0], key[:0]


def _solve(batches: Iterator[pa.RecordBatch], similarity: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by node."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        node = table.column("node").to_numpy()
        again = node[1:] == node[:-1]
        table = table.filter(pa.array(np.r_[again, False] | np.r_[False, again]))  # alone in a node: nothing to compare
        ids = table.column("doc_id").to_numpy()
        if not len(ids):
            return pa.RecordBatch.from_arrays([pa.array(ids)] * 3, ["a", "b", "crowd"])
        col = lambda c: table.column(c).to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
        a, b, rows, crowd = compare(col("node").view(np.uint64), col("tree"), col("depth"), col("n"), col("label"), sketch, similarity, forest)
        b = pa.concat_arrays([pa.array(ids[b]), pa.nulls(len(rows), pa.int64())])
        crowd = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(crowd.view(np.int64))])
        return pa.RecordBatch.from_arrays([pa.array(np.r_[ids[a], ids[rows]]), b, crowd], ["a", "b", "crowd"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1 << 16:
            table = pa.Table.from_batches(held)
            keys = table.column("node").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last node may go on
            if cut:
                yield flush(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield flush(pa.Table.from_batches(held))


def _confirm(batches: Iterator[pa.RecordBatch], k: int, similarity: float) -> Iterator[pa.RecordBatch]:
    percent = round(100 * similarity)
    for batch in batches:
        for part in _slices(batch, "text_a"):
            one, n = shingle_sets(Texts(part.column("text_a")), k)
            two, m = shingle_sets(Texts(part.column("text_b")), k)
            both = np.bincount((np.intersect1d(one, two, assume_unique=True) >> np.uint64(48)).astype(np.int64), minlength=part.num_rows)
            yield part.select(["a", "b"]).filter(pa.array((100 * both >= percent * (n + m - both)) & (both > 0)))


def _thinned(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Hashes of a text's set; of a large set those with ``level`` zero bits at the end, THIN / 2 or more on average."""
    for batch in batches:
        for part in _slices(batch, "text"):
            code, n = shingle_sets(Texts(part.column("text")), k)
            level = np.maximum(np.ceil(np.log2(np.maximum(n, 1) / THIN)), 0).astype(np.int64)
            of = (code >> np.uint64(48)).astype(np.int64)
            code &= np.uint64((1 << 48) - 1)
            stay = code & ((np.uint64(1) << level[of].astype(np.uint64)) - np.uint64(1)) == 0
            cut = np.cumsum(np.bincount(of[stay], minlength=len(n)))[:-1]
            sets = pa.array([x.tobytes() for x in np.split(code[stay], cut)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(level.astype(np.int32)), sets], ["doc_id", "level", "codes"])


def _meet(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come by part and block of a crowd; those that ask are compared with the block's rows of other labels, on their sets.

    Where these are whole, the best partner of a row in each other label is enough to join the two. Thinned sets are
    within 3.8 standard deviations of what the whole ones have in common, and all that may be similar go on.
    """

    def flush(rows: list[dict]) -> pa.RecordBatch:
        level = max(r["level"] for r in rows)
        sets = [np.frombuffer(r["codes"], np.uint64) for r in rows]
        if level:
            sets = [x[x & np.uint64((1 << level) - 1) == 0] for x in sets]
        n = np.array([len(x) for x in sets])
        end = np.cumsum(n)
        kinds, item = np.unique(np.concatenate(sets), return_inverse=True)
        label, ids = np.array([r["label"] for r in rows]), np.array([r["doc_id"] for r in rows])
        asks, most = np.array([r["asks"] for r in rows]), np.array([r["most"] for r in rows])
        mine, out = np.zeros(len(kinds), bool), [np.zeros((2, 0), np.int64)]
        for k in np.flatnonzero(asks):
            own = item[end[k] - n[k] : end[k]]
            mine[own] = True
            seen = np.r_[0, np.cumsum(mine[item])]
            both = seen[end] - seen[end - n]
            mine[own] = False
            union = np.maximum(n + n[k] - both, 1)
            least = similarity - 1e-9 if not level else similarity - 3.8 * np.sqrt(similarity * (1 - similarity) / union)
            near = np.flatnonzero(~asks & (most | (ids > ids[k])) & (label != label[k]) & ((both / union >= least) & (both > 0) | (level > 0) & (n + n[k] < THIN // 4)))
            if not level:
                near = near[np.lexsort((-both[near] / union[near], label[near]))]
                near = near[np.r_[True, label[near][1:] != label[near][:-1]]] if len(near) else near
            out.append(np.stack([np.full(len(near), ids[k]), ids[near]]))
        a, b = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][c] != row[c] for c in ("crowd", "part", "block")):
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def crowd_pairs(rows: DataFrame, lead: DataFrame, crowds: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs a < b between labels in crowds, compared on sets; no row is written for a candidate.

    A crowd's rows of other labels than most (``most``) ask; all rows answer. Both are cut into parts and blocks of bounded
    size, so that no task holds a whole crowd.
    """
    sets = rows.join(_few(materialize(crowds.select("doc_id").distinct(), "crowd-ids")), "doc_id", "left_semi")
    sets = materialize(sets.mapInArrow(partial(_thinned, k=shingle), "doc_id long, level int, codes binary"), "crowd-sets")
    members = materialize(crowds.distinct().join(lead.select("doc_id", "label").distinct(), "doc_id"), "crowd-members")
    kinds = members.groupBy("crowd", "label").agg(F.count("*").alias("rows"))
    size = kinds.groupBy("crowd").agg(F.max(F.struct("rows", "label")).alias("top"), F.sum("rows").alias("rows")).where("rows > top.rows")
    cuts = lambda c, n: F.ceil(c / F.lit(n)).cast("int")
    size = size.select("crowd", F.col("top.label").alias("main"), cuts(F.col("rows"), BLOCK).alias("blocks"), cuts(F.col("rows") - F.col("top.rows"), PART).alias("parts"))
    members = members.join(_few(materialize(size, "crowd-sizes")), "crowd").withColumn("most", F.col("label") == F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n)
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = members.where("NOT most").select("crowd", "doc_id", "label", "most", F.lit(True).alias("asks"), place("parts").cast("int").alias("part"), deal("blocks").alias("block"))
    answer = members.select("crowd", "doc_id", "label", "most", F.lit(False).alias("asks"), deal("parts").alias("part"), place("blocks").cast("int").alias("block"))
    met = asking.unionByName(answer).join(sets, "doc_id").repartition("crowd", "part", "block").sortWithinPartitions("crowd", "part", "block")
    found = met.mapInArrow(partial(_meet, similarity=similarity), "a long, b long")
    return materialize(found.where("a < b").distinct(), "crowd-pairs")


def _few(ids: DataFrame) -> DataFrame:
    """Written ids, for a broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def candidates(lead: DataFrame, trees: int, similarity: float, forest: bool) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs a < b of documents with different labels, from so many trees; members of crowds (crowd, doc_id)."""
    rows = lead.mapInArrow(partial(_paths, trees=trees), _NODE)
    done, crowd = [], None
    for level in range(FIRST, DEEPEST + 1):  # nodes that are too large for a task branch here, on and on
        size = rows.groupBy("node").agg(F.count("*").alias("rows"), (F.min("label") != F.max("label")).alias("mixed")).where(F.col("rows") > MOST)
        large = materialize(size.select(F.col("node").alias("large"), F.ceil(F.col("rows") / MOST).cast("int").alias("cuts"), "mixed"), "large")
        if not large.limit(1).count():
            done.append(rows)
            break
        done.append(rows.join(_few(large), F.col("node") == F.col("large"), "left_anti"))
        rows = rows.join(_few(large.where("mixed")), F.col("node") == F.col("large")).drop("large", "mixed")  # one label alone has nothing to compare
        if level < DEEPEST:
            token = F.substring("sketch", (F.col("tree") * DEPTH + level) % VALUES + 1, F.lit(1))
            rows = materialize(rows.drop("cuts").withColumn("depth", F.lit(level + 1)).withColumn("node", F.xxhash64("node", token)), "branch")
        elif forest:  # no token splits it: parts of the node, each with the node's first document
            rows = materialize(rows, "unsplit")
            own = [F.col(c) for c in rows.columns if c not in ("node", "cuts")]
            first = rows.groupBy("node").agg(F.min_by(F.struct(*own), "doc_id").alias("r"), F.first("cuts").alias("cuts"))
            first = first.select("node", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "r.*")
            other = rows.withColumn("cut", F.pmod(F.xxhash64("doc_id"), "cuts").cast("int")).select(first.columns)
            done.append(first.unionByName(other).withColumn("node", F.xxhash64("node", "cut")).drop("cut").dropDuplicates(["node", "doc_id"]))
        else:
            crowd = materialize(rows.select(F.col("node").alias("crowd"), "doc_id"), "unsplit")
    rows = reduce(DataFrame.unionByName, done)
    found = rows.repartition("node").sortWithinPartitions("node", "doc_id").mapInArrow(partial(_solve, similarity=similarity, forest=forest), "a long, b long, crowd long")
    found = materialize(found, "found")
    pairs = found.where("crowd IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    crowds = found.where("crowd IS NOT NULL").select("crowd", F.col("a").alias("doc_id"))
    return materialize(pairs, "pairs"), crowds if crowd is None else crowds.unionByName(crowd)


def confirmed(rows: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs that are similar on their full sets."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    texts = materialize(rows.join(_few(ends), "doc_id", "left_semi"), "texts")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(partial(_confirm, k=shingle, similarity=similarity), "a long, b long"), "links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links), kept (doc_id = component_id) for each row of ``docs``.

    Documents are linked where the Jaccard similarity of their sets is ``similarity`` or more. Words are lower-cased
    (A-Z) and whole texts count. A text without words, or null, is linked with nothing. Equal sets are one node of the
    join, so that exact copies cost no comparison. Rows that repeat an id are one document with the links of all of them.
    A row without an id is linked with nothing, has a null component and is kept. Ids are whole numbers, or are cast to
    them; text that is none counts as no id. No rows give no rows.

    A group of thousands of near copies would make candidates in the square of its size. So a first round, over half of
    the trees, confirms only the likeliest links that hold a node's documents together; a second one, over all trees,
    confirms every candidate whose ends are still in different components. Rows at the edge of a large group resemble most
    of it without being linked; a node with many such candidates is a crowd, whose rows are compared on their sets in place.
    """
    rows = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sets = materialize(rows.mapInArrow(partial(_describe, k=shingle), "doc_id long, n long, name1 long, name2 long, least binary"), "sets")
    key = ["n", "name1", "name2"]
    known = sets.where("n > 0 AND doc_id IS NOT NULL")
    heads = materialize(known.groupBy(*key).agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")), "heads")
    copies = known.select("doc_id", *key).join(_few(heads.where("rows > 1").drop("rows")), key).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    copies = materialize(copies, "copies")
    lead = known.join(_few(copies.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_anti").select("doc_id", "n", "least")

    pairs, _ = candidates(lead.withColumn("label", F.col("doc_id")), TREES // 2, similarity, True)
    links = confirmed(rows, pairs, shingle, similarity)
    label = materialize(components(links), "labels")
    lead = lead.join(_few(label), F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "least", F.coalesce("component", "doc_id").alias("label"))
    more, crowds = candidates(lead, TREES, similarity, False)
    if crowds.limit(1).count():
        more = more.unionByName(crowd_pairs(rows, lead, crowds, shingle, similarity)).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "more")
    links = links.unionByName(confirmed(rows, more, shingle, similarity))

    label = materialize(components(links.unionByName(copies)), "labels")
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles")).join(label, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
