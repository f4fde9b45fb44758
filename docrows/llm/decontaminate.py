"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Edits are counted in words. An item of n words is found in a document if consecutive words there, as many as may be, are
within a fifth of n edits. Items of over PIECE words are cut into pieces alike in size. However the edits lie, some piece has
at most its fifth of them, so that the LSH looks for pieces, each in windows of its own size; an item of up to PIECE words is
one piece. Of a piece with at most k edits, one of k + 1 segments is left intact and all but k of its words remain; windows
that fail either test can't match, and are dropped before they are embedded. The CGK walk embeds piece and window with the
same random bits: at each of 3n steps it writes the word it stands at, and moves on or stays as the bit for this step and
word says. So edits become differing symbols. A repetition samples a few steps of a walk of its own; windows that agree with
the piece there, in any repetition, are candidates, around which the whole item's distance is verified. The walk's bits
depend on step and word alone, so that pieces and windows of any width are embedded alike, widest together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, fixed64, materialize, mix, span_hash, word_count

#: Repetitions and sampled steps. Measured on windows with a fifth of their words edited, 32 repetitions find over 0.99.
REPEATS, SAMPLES = 32, 2
#: Words of a piece: walks through more edits than it may hold part for good.
PIECE = 48
#: Items, and their words, that are sent to all tasks at once; a larger benchmark takes a pass over the documents for each block.
ITEMS, WORDS = 20_000, 4_000_000
#: Words of windows that are embedded at once; a wider window is embedded alone.
CELLS = 1 << 20
_PAD = np.uint64(1)


def distances(a: list[int], b: list[int], anywhere: bool = False) -> Iterator[int]:
    """Levenshtein distance of a to each beginning of b, from one word on; ``anywhere``: to the nearest end part of each.

    A column of the table is held in the bits of an integer.
    """
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full, top, first = (1 << len(a)) - 1, 1 << (len(a) - 1), 0 if anywhere else 1
    plus, minus, distance = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        distance += bool(up & top) - bool(down & top)
        yield distance
        up, down = (up << 1 | first) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal


def edit_distance(a: list[int], b: list[int]) -> int:
    """Levenshtein distance of two sequences."""
    return [len(a), *distances(a, b)][-1] if a else len(b)


def best_window(a: list[int], b: list[int], most: int) -> tuple[int, int] | None:
    """(edits, start) of the part of b nearest to a, the first of equally near ones; None if it is over ``most`` edits away."""
    ends = list(distances(a, b, anywhere=True))
    least = min(ends, default=most + 1)
    if least > most:
        return None
    first, start = ends.index(least), len(b)
    for end in range(first, min(first + 2 * least + 1, len(ends))):  # a later end can't have an earlier start
        if ends[end] == least:
            back = b[max(0, end - len(a) - least + 1) : end + 1][::-1]
            start = min(start, end - max(n for n, d in enumerate(distances(a[::-1], back)) if d == least))
    return least, start


def by_width(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in parts of similar width, each of CELLS words at most when padded, or one row."""
    order = np.argsort(sizes, kind="stable")
    while len(order):
        fits = np.flatnonzero(np.arange(1, len(order) + 1) * sizes[order] > CELLS)
        cut = max(int(fits[0]), 1) if len(fits) else len(order)
        yield order[:cut]
        order = order[cut:]


def embed(windows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """CGK signatures, one for each repetition and window. ``windows``: word hashes, padded; ``sizes``: pieces' words."""
    bits = np.stack([fixed64(3 * windows.shape[1], seed + 1_000_003 * (r + 1)) for r in range(REPEATS)])
    pick = fixed64(REPEATS * SAMPLES, seed + 1).reshape(REPEATS, SAMPLES)
    steps = (pick[:, :, None] % (3 * sizes.astype(np.uint64))[None, None, :]).astype(np.int64)  # repetition, sample, window
    place = np.zeros((REPEATS, len(windows)), np.int64)
    sign = np.zeros((REPEATS, len(windows)), np.uint64)
    row = np.arange(len(windows))[None, :]
    padded = np.c_[windows, np.full(len(windows), _PAD)]
    for j in range(int(steps.max(initial=-1)) + 1):
        here = padded[row, np.minimum(place, windows.shape[1])]
        for s in range(SAMPLES):
            sign += np.where(steps[:, s] == j, mix(here + np.uint64(s)), np.uint64(0))
        place += (mix(here ^ bits[:, j : j + 1]) >> np.uint64(63)).astype(np.int64)
    return sign


class Index:
    """Items of a block with their edits allowed, and their pieces with theirs, found by segments of each length."""

    def __init__(self, items: list[tuple[int, str, int]], share: float, min_words: int):
        t = Texts(pa.array([x for _, x, _ in items], pa.string())).lower_ascii().words()
        words = t.hashes()
        allowed = lambda n: int(n * share + 1e-9)
        self.items, pieces = [], []
        segments = defaultdict(list)
        for (name, _, times), a, b in zip(items, t.first[:-1], t.first[1:]):
            if b - a < min_words:
                continue
            parts = -(-(b - a) // PIECE)
            for k in range(parts):
                c, d = a + (b - a) * k // parts, a + (b - a) * (k + 1) // parts
                edits = allowed(d - c)
                cut = [(d - c) * i // (edits + 1) for i in range(edits + 2)]
                for x, y in zip(cut[:-1], cut[1:]):
                    size = min(y - x, 4)
                    segments[size].append((int(span_hash(words[c:d], np.array([x]), np.array([x + size]))[0]), len(pieces), x))
                pieces.append((len(self.items), c - a, words[c:d], edits))
            self.items.append((name, words[a:b].tolist(), allowed(b - a), times))
        self.segments = {}
        for size, found in segments.items():
            found.sort()
            code = np.array([f[0] for f in found], np.uint64)
            maybe = np.zeros(1 << 20, bool)
            maybe[code >> np.uint64(44)] = True
            self.segments[size] = code, np.array([f[1] for f in found]), np.array([f[2] for f in found]), maybe
        if pieces:
            self.of, self.offset, self.words, edits = zip(*pieces)
            self.sizes, self.edits = np.array([len(w) for w in self.words]), np.array(edits)
            self.signs = np.zeros((REPEATS, len(pieces)), np.uint64)
            for rows in by_width(self.sizes):
                padded = np.full((len(rows), self.sizes[rows].max()), _PAD)
                for k, i in enumerate(rows):
                    padded[k, : self.sizes[i]] = self.words[i]
                self.signs[:, rows] = embed(padded, self.sizes[rows], 5)

    def hits(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with their texts, and word positions where a piece may begin there, from intact segments."""
        pieces, starts = [], []
        for size, (code, piece, offset, maybe) in self.segments.items():
            if len(words) < size:
                continue
            at = np.arange(len(words) - size + 1)
            gram = span_hash(words, at, at + size)
            at = np.flatnonzero(maybe[gram >> np.uint64(44)])
            at = at[of[at] == of[at + size - 1]]
            a, b = np.searchsorted(code, gram[at], "left"), np.searchsorted(code, gram[at], "right")
            many = b - a
            which = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pieces.append(np.stack([piece[which], np.repeat(of[at], many)]))
            starts.append(np.repeat(at, many) - offset[which])  # may lie before the text
        if not pieces:
            return np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        return np.concatenate(pieces, axis=1), np.concatenate(starts)

    def candidates(self, words: np.ndarray, first: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, piece, start) of the windows that the LSH takes for a piece."""
        (piece, text), start = self.hits(words, of)
        if not len(piece):
            return
        piece, text, start = np.unique(np.stack([piece, text, start]), axis=1)
        keep = []
        for i in np.unique(piece):  # at least n - k of the piece's words stand near
            own = np.flatnonzero(piece == i)
            w, k = self.words[i], self.edits[i]
            known = np.unique(w)
            for s in range(0, len(own), 4096):
                r = own[s : s + 4096]
                at = start[r][:, None] + np.arange(-k, len(w) + k)[None, :]
                inside = (at >= first[text[r]][:, None]) & (at < first[text[r] + 1][:, None])
                got = words[np.clip(at, 0, len(words) - 1)]
                slot = np.minimum(np.searchsorted(known, got), len(known) - 1)
                keep.append(r[((known[slot] == got) & inside).sum(axis=1) >= len(w) - k])
        keep = np.concatenate(keep)
        if not len(keep):
            return
        keep.sort()  # again by piece, text and start
        piece, text, start = piece[keep], text[keep], start[keep]
        k = self.edits[piece]
        again = np.r_[False, (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])]
        many = np.where(again, np.minimum(2 * k + 1, start - np.r_[start[:1], start[:-1]]), 2 * k + 1)  # starts that no earlier hit has named
        which = np.repeat(np.arange(len(piece)), many)
        start = np.repeat(start + k - many + 1, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        piece, text = piece[which], text[which]
        good = (start >= first[text]) & (start + self.sizes[piece] - self.edits[piece] <= first[text + 1])
        piece, text, start = piece[good], text[good], start[good]
        for rows in by_width(self.sizes[piece]):
            i, t, p = piece[rows], text[rows], start[rows]
            at = p[:, None] + np.arange(self.sizes[i].max())[None, :]
            stop = np.minimum(p + self.sizes[i], first[t + 1])
            windows = np.where(at < stop[:, None], words[np.minimum(at, len(words) - 1)], _PAD)
            found = (embed(windows, self.sizes[i], 5) == self.signs[:, i]).any(axis=0)
            yield from zip(t[found].tolist(), i[found].tolist(), p[found].tolist())

    def search(self, words: np.ndarray, first: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, edits) of the best window of each item in each text; the first of equally good ones."""
        places = defaultdict(list)
        for text, piece, start in self.candidates(words, first, of):
            item = self.of[piece]
            spare = self.items[item][2] + int(self.edits[piece])  # words that edits before the piece can move it by
            begin = start - self.offset[piece]
            places[text, item].append((begin - spare, begin + len(self.items[item][1]) + 2 * spare))
        for (text, item), near in places.items():
            _, w, k, _ = self.items[item]
            low, high = int(first[text]), int(first[text + 1])
            near.sort()
            merged = [near[0]]
            for a, b in near[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                else:
                    merged.append((a, b))
            found = []
            for a, b in merged:
                a, b = max(a, low), min(b, high)
                if best := best_window(w, words[a:b].tolist(), k):
                    found.append((best[0], best[1] + a - low))
            if found:
                edits, start = min(found)
                yield text, item, start, edits


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.2, min_words: int = 5) -> DataFrame:
    """doc_id, item_id, start (word of the best window), edits: a row for each document row and each item found in it.

    Whole texts are searched; A-Z count as lower case. Items of fewer than ``min_words`` words, or null, are not searched
    for; a text without words, or null, holds none. Rows that repeat, items too, are answered one by one; repeated items are
    searched for once. No documents or no items give no rows. The benchmark is the query set: blocks of ITEMS items and WORDS
    words at most (or one longer item) go to all tasks, one after the other. ``start`` and ``edits`` are of the best window, the first of equally good ones.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    items = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[item_text].alias("text")).where("text IS NOT NULL")
    items = materialize(items.groupBy("item_id", "text").agg(F.count("*").alias("times")), "items")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start int, edits int"
    kinds = [pa.int32(), pa.int32()]
    size = items.agg(F.count("*"), F.sum(word_count(F.col("text")))).first()
    blocks = max(1, -(-size[0] // (ITEMS // 2)), -(-(size[1] or 0) // (WORDS // 2)))  # half full on average, as blocks differ
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in part.orderBy("item_id", "text").collect()], share, min_words))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for piece in chunks(batch, "text"):
                    t = Texts(piece.column("text")).lower_ascii().words()
                    if not len(t.starts) or not index.items:
                        continue
                    of = np.repeat(np.arange(piece.num_rows), np.diff(t.first))
                    found = sorted(index.search(t.hashes(), t.first, of))
                    if found:
                        text, item, start, edits = zip(*(f for f in found for _ in range(index.items[f[1]][3])))
                        names = pa.array([index.items[i][0] for i in item])
                        yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(text)), names, pa.array(start, kinds[0]), pa.array(edits, kinds[1])], ["doc_id", "item_id", "start", "edits"])

        found = rows.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out
