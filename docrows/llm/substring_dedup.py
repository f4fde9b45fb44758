"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against all documents with smaller ids. The reference is indexed by phrases of ``window``
words: a phrase's address is the smallest hash among its half-sized word grams, so that equal phrases have equal addresses
and neighbouring phrases mostly share one. A phrase is compared by 64 bits, and only with those at its address: among the
26 million phrases of an address of 10^13, the odds of a false match are 1 in 50,000.

Parsing is greedy: from a phrase that the reference holds, a factor goes on in the reference's document as long as the two
match, and the next factor begins behind it. A factor is kept if it is a whole window long. Phrases across the boundary of
two factors are looked up like any other, so that nothing is missed where one factor ends and another begins.

A task first factors each block of text against itself. What it finds there is decided, and only the first copy of a
phrase goes on. Phrases that a block repeats are remembered with their first place, and later blocks of the task are
factored against these too. So a passage that a third of all documents share reaches its address about once for each task,
not for each document or block.

A short passage that very many documents share among other words makes phrases of its own in each of them, all at one
address. Such hot addresses are found first, and their phrases are dealt by address and phrase; only that factors there are
single phrases, not runs, comes of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, mix, span_hash

WINDOW = 50
#: Bytes of text that a task factors against themselves, and phrases that it matches at once.
BLOCK = 2 << 20
BUFFER = 1 << 20
#: Repeated phrases that a task remembers (24 bytes each). Those that are forgotten are only sent once more.
KNOWN = 1 << 20
#: Of texts, one in so many is read to find hot addresses. Only how the work is dealt depends on it, not what is found.
SAMPLED = 16
#: Phrases among those read from which on an address is hot, and the most addresses that are (8 bytes each); the largest go first.
HOT, HOT_MOST = BUFFER // SAMPLED // 4, 100_000
#: Rows without an id come after all others.
NO_ID = np.iinfo(np.int64).max

_SENT = "address long, doc_id long, fp long, start int, stop int, phrases binary, ref_doc long, ref_start int"
_FACTOR = "doc_id long, fp long, start int, stop int, ref_doc long, ref_start int"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i where that many values stand."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def parse(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that stand in a smaller document, and the first place of each. Phrases come by document and place."""
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(code)
    ordered = code[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    head = np.empty(len(code), np.int64)
    head[order] = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.r_[begin, len(code)]))
    found = np.flatnonzero(doc > doc[head])
    return found, head[found]


def greedy(code: np.ndarray, row: np.ndarray, place: np.ndarray, found: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of the phrases ``found``, of which ``head`` are the first places: first and last phrase, and where it begins there.

    Runs in which text and reference go on together are the start. Only a run that matches on behind its end, where another
    place of the reference came first, is followed step by step; runs that it covers are left out.
    """
    first, last = factors(row[found], place[found], row[head], place[head])
    a, b, h = found[first], found[last], head[first]
    n = len(code)

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the phrases behind x and y follow them directly, and are equal."""
        u, v = np.minimum(x + 1, n - 1), np.minimum(y + 1, n - 1)
        on = lambda i, j: (j > i) & (row[j] == row[i]) & (place[j] == place[i] + 1)
        return on(x, u) & on(y, v) & (code[u] == code[v])

    if not joined(b, h + (b - a)).any():
        return a, b, h
    out, nxt = [], 0
    for i, j, k, more in zip(a.tolist(), b.tolist(), h.tolist(), joined(b, h + (b - a)).tolist()):
        if j < nxt:
            continue
        if i < nxt:
            i, k = nxt, k + nxt - i
        while more:
            step = np.arange(j, min(j + 4096, n - 1))
            stop = np.flatnonzero(~joined(step, step - i + k))
            j, more = (int(step[stop[0]]), False) if len(stop) else (int(step[-1]) + 1, j + 4096 < n - 1) if len(step) else (j, False)
        out.append((i, j, k))
        nxt = j + 1
    i, j, k = np.array(out, np.int64).reshape(-1, 3).T
    return i, j, k


class Memory:
    """Repeated phrases of a task's blocks, with the smallest document that holds each, and the place there."""

    def __init__(self):
        self.code, self.doc, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, code: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
        kept = len(self.code) if len(self.code) + len(code) <= KNOWN else 0
        code, doc, place = (np.r_[old[:kept], new[:KNOWN]] for old, new in ((self.code, code), (self.doc, doc), (self.place, place)))
        order = np.lexsort((place, doc, code))
        code, doc, place = code[order], doc[order], place[order]
        new = np.r_[True, code[1:] != code[:-1]][: len(code)]
        self.code, self.doc, self.place = code[new], doc[new], place[new]

    def earlier(self, code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases stand in a smaller document that is remembered, and their places here."""
        if not len(self.code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        own = np.flatnonzero((self.code[at] == code) & (self.doc[at] < doc))
        return own, at[own]


def factors(row: np.ndarray, place: np.ndarray, ref: np.ndarray, ref_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last phrase of each factor: phrases that follow one another in a text and in its reference."""
    new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_place[1:] != ref_place[:-1] + 1)]
    first = np.flatnonzero(new)
    return first, np.r_[first[1:], len(row)] - 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _null_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def _phrases(t: Texts, rows: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the text of each word, the words at which a phrase begins, and the phrases' addresses."""
    gram, n = window // 2, len(t.starts)
    of = np.repeat(np.arange(rows), np.diff(t.first))
    words = t.hashes()
    at = np.flatnonzero(of[: max(n - window + 1, 0)] == of[window - 1 :])
    if not len(at):
        return words, of, at, np.zeros(0, np.uint64)
    grams = np.arange(n - gram + 1)
    return words, of, at, sliding_min(span_hash(words, grams, grams + gram), window - gram + 1)[at]


def _addresses(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Addresses of a block's texts and how many phrases each has."""
    for batch in batches:
        for part in chunks(batch, "text", BLOCK):
            found, n = np.unique(_phrases(Texts(part.column("text")).words(), part.num_rows, window)[3], return_counts=True)
            many = n > 1  # one phrase of a block makes no address hot
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many])], ["address", "n"])


def hot_addresses(rows: DataFrame, window: int) -> np.ndarray:
    """Addresses with so many phrases that no task should have one to itself, in order."""
    some = rows.where(F.pmod("fp", F.lit(SAMPLED)) == 0).select("text").mapInArrow(partial(_addresses, window=window), "address long, n long")
    hot = some.groupBy("address").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "address").limit(HOT_MOST)
    return np.sort(np.array([r["address"] for r in hot.collect()], np.int64).view(np.uint64))


def _send(batches: Iterator[pa.RecordBatch], window: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    memory = Memory()
    names = [x.split()[0] for x in _SENT.split(", ")]
    for batch in batches:
        for part in chunks(batch, "text", BLOCK):
            part = part.take(pa.array(np.argsort(_ids(part.column("doc_id")), kind="stable")))
            t = Texts(part.column("text")).words()
            ids, fp = _ids(part.column("doc_id")), part.column("fp").to_numpy(zero_copy_only=False)
            words, of, at, address = _phrases(t, len(ids), window)
            if not len(at):
                continue
            code = span_hash(words, at, at + window)
            if len(hot):
                crowded = hot[np.minimum(np.searchsorted(hot, address), len(hot) - 1)] == address
                address = np.where(crowded, mix(address ^ code), address)  # equal phrases still meet
            row, place = of[at], at - t.first[of[at]]
            found, head = parse(code, ids[row])

            def sent(f: np.ndarray, last: np.ndarray, doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(fp[row[f]]), _null_ids(ids[row[f]]), pa.array(fp[row[f]]), pa.array(place[f].astype(np.int32)), pa.array((place[last] + window).astype(np.int32)),
                     pa.nulls(len(f), pa.binary()), _null_ids(doc), pa.array(start.astype(np.int32))], names)

            left = np.ones(len(at), bool)
            left[found] = False
            own, seen = memory.earlier(code[left], ids[row[left]])
            own = np.flatnonzero(left)[own]
            left[own] = False
            if len(own):
                a, b = factors(row[own], place[own], memory.doc[seen], memory.place[seen])
                yield sent(own[a], own[b], memory.doc[seen[a]], memory.place[seen[a]])
            if len(found):
                f, last, h = greedy(code, row, place, found, head)
                yield sent(f, last, ids[row[h]], place[h])
                h = np.unique(head)
                memory.add(code[h], ids[row[h]], place[h])
            row, place, address, code = row[left], place[left], address[left], code[left]
            if not len(row):
                continue
            new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (address[1:] != address[:-1])]
            first = np.flatnonzero(new)
            offsets = np.r_[first, len(row)].astype(np.int64) * 8
            phrases = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(code))])
            none = pa.nulls(len(first), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(address[first].view(np.int64)), _null_ids(ids[row[first]]), pa.array(fp[row[first]]), pa.array(place[first].astype(np.int32)),
                 none, phrases, pa.nulls(len(first), pa.int64()), none], names)


def _match(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come by address; those of an address are matched together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids = _ids(table.column("doc_id").combine_chunks())
        start = table.column("start").to_numpy()
        by = np.lexsort((start, table.column("fp").to_numpy(), ids))
        table = table.take(pa.array(by)).combine_chunks()
        ids, start = ids[by], start[by]
        fp = table.column("fp").to_numpy()
        phrases = table.column("phrases").combine_chunks()
        if isinstance(phrases, pa.ChunkedArray):
            phrases = phrases.chunk(0) if phrases.num_chunks else pa.array([], pa.binary())
        code = np.frombuffer(b"".join(phrases.to_pylist()), np.uint64)
        many = np.array(pc.binary_length(phrases)) // 8
        row = np.repeat(np.arange(len(ids)), many)
        place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        of = np.cumsum(np.r_[True, (ids[1:] != ids[:-1]) | (fp[1:] != fp[:-1])])[row] if len(ids) else row  # texts, which may have several rows
        found, head = parse(code, ids[row])
        f, last, h = greedy(code, of, place, found, head) if len(found) else (found,) * 3
        return pa.RecordBatch.from_arrays(
            [_null_ids(ids[row[f]]), pa.array(fp[row[f]], pa.int64()), pa.array(place[f].astype(np.int32)), pa.array((place[last] + window).astype(np.int32)),
             _null_ids(ids[row[h]]), pa.array(place[h].astype(np.int32))], [x.split()[0] for x in _FACTOR.split(", ")])

    for batch in batches:
        done = batch.filter(pc.is_valid(batch.column("stop")))
        if done.num_rows:
            yield done.select(["doc_id", "fp", "start", "stop", "ref_doc", "ref_start"])
        batch = batch.filter(pc.is_null(batch.column("stop")))
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("phrases"))).as_py() // 8
        if size >= BUFFER:
            table = pa.Table.from_batches(held)
            keys = table.column("address").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last address may go on
            if cut:
                yield flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = pc.sum(pc.binary_length(table.slice(cut).column("phrases"))).as_py() // 8
    if held:
        yield flush(pa.Table.from_batches(held))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", BLOCK):
            total, removed, kept = [], [], []
            for text, spans in zip(part.column("text"), part.column("spans")):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                gone = 0
                if spans.is_valid and len(spans.values):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, spans.values.field("start").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("stop").to_numpy(), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), part.column("spans"), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "factors", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Factor each document against those with smaller ids and remove the words that factors cover.

    Returns doc_id, n_words, n_removed, factors (array of start, stop, ref_doc, ref_start in words) and kept_text (kept
    words joined by one space), a row for each row of ``docs``. Whole texts count, on the input as it is: a removed copy is
    a reference all the same. Null text has no words; texts under ``window`` words keep all. Rows without an id come after
    all others and don't take words from each other; nor do rows that repeat an id. Ids are whole numbers, or are cast to
    them; text that is none counts as no id. No rows give no rows.
    """
    rows = docs.select(docs[id_col].try_cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("fp"), docs[text_col].alias("text"))
    found = (
        rows.mapInArrow(partial(_send, window=window, hot=hot_addresses(rows, window)), _SENT)
        .repartition("address").sortWithinPartitions("address")
        .mapInArrow(partial(_match, window=window), _FACTOR)
        .groupBy("doc_id", "fp").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "ref_doc", "ref_start"))).alias("spans"))
        .select(F.col("doc_id").alias("f_id"), F.col("fp").alias("f_fp"), "spans")
    )
    whole = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("fp") == F.col("f_fp")), "left").select("doc_id", "text", "spans")
    span = "array<struct<start:int,stop:int,ref_doc:bigint,ref_start:int>>"
    return whole.mapInArrow(_keep, f"doc_id long, n_words long, n_removed long, factors {span}, kept_text string")
