"""Helpers that several operators share: shared-folder tables, text chunks, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_dir

#: The white space between words; everything else belongs to a word.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


_made: list[str] = []  # tables that this session has written and not deleted


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, and a lost executor costs nothing.

    ``keep``: it is a result, and stays when ``own_tables`` deletes what was written on the way to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docrows/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block, but for those to keep, are deleted at its end; what is read from them must be written by then."""
    mark = len(_made)
    try:
        yield
    finally:
        for path in _made[mark:]:
            remove(spark, path)
        del _made[mark:]


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts as no text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fixed64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers by rule (splitmix64 of a counter)."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_BYTE = fixed64(256, 7)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's odd base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


class Texts:
    """Whole texts of a batch as one UTF-8 buffer. ``offs``: where each begins; null is the empty text."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.offs = raw - raw[0]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[raw[0] : raw[-1]] if data is not None and raw[-1] > raw[0] else np.zeros(0, np.uint8)

    def lower_ascii(self) -> "Texts":
        self.data = self.data + ((self.data >= 65) & (self.data <= 90)).astype(np.uint8) * np.uint8(32)
        return self

    def words(self) -> "Texts":
        """Find words; ``starts`` and ``ends`` in bytes, ``first``: index of each text's first word, one more at the end."""
        n = len(self.data)
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        w = np.zeros(n + 2, bool)
        w[1:-1] = ~_GAP[self.data]
        self.starts = np.flatnonzero(w[1:-1] & (~w[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(w[1:-1] & (~w[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offs)
        return self

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hash(_BYTE[self.data], self.starts, self.ends)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash of values[start:end], mixed with the length; equal spans hash alike wherever they stand."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(batch: pa.RecordBatch, text: str, limit: int = 1 << 20):
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cut = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
    for a, b in zip(cut[:-1], cut[1:]):
        yield batch.slice(a, b - a)
