"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs. A trigram's vector binds its letters' vectors, the first two of them permuted
(rolled by two places and by one). A text bundles its trigrams' vectors, a language its texts'; the language whose
prototype has the largest cosine with the text is predicted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fixed64, materialize

DIMENSIONS = 1024
#: Languages whose profiles go to the tasks at once (8 MB for 1,024 dimensions); more take a pass over the texts for each block.
LANGUAGES = 1000
#: Length of a prototype in whole numbers.
SCALE = float(1 << 20)
_LAST = 0x110000


def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(_LAST)), np.uint8).astype(bool)


_cache: dict = {}


def letter_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """Signs by rule from the code point; row i is the vector of codes[i]."""
    words = np.stack([fixed64(dims // 64, int(c) * 1_000_003 + 11) for c in codes]) if len(codes) else np.zeros((0, dims // 64), np.uint64)
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def bundle(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of summed trigram vectors for each text, and whether it has a letter. Words are letters with a space on either side."""
    if "letters" not in _cache:
        _cache["letters"] = _letters()
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64) + 2
    code = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    code[~_cache["letters"][code]] = 32
    doc = np.repeat(np.arange(len(low)), size)
    keep = np.r_[True, (code[1:] != 32) | (code[:-1] != 32) | (doc[1:] != doc[:-1])]
    code, doc = code[keep], doc[keep]
    has = np.bincount(doc[code != 32], minlength=len(low)) > 0
    seen = np.zeros(_LAST, bool)
    seen[code] = True
    alphabet = np.flatnonzero(seen)
    index = np.zeros(_LAST, np.int64)
    index[alphabet] = np.arange(len(alphabet))
    x, k = index[code], len(alphabet)
    whole = doc[2:] == doc[:-2]
    tri, of = ((x[:-2] * k + x[1:-1]) * k + x[2:])[whole], doc[2:][whole]
    if k**3 <= 1 << 22:
        there = np.zeros(k**3, bool)
        there[tri] = True
        kinds = np.flatnonzero(there)
        rank = np.zeros(k**3, np.int64)
        rank[kinds] = np.arange(len(kinds))
        rank = rank[tri]
    else:
        kinds, rank = np.unique(tri, return_inverse=True)
    v = letter_vectors(alphabet, dims)
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    exact = np.float32 if size.max(initial=0) < 1 << 24 else np.float64  # whole numbers below 2**24 are exact in either
    out = np.zeros((len(low), dims))
    for a in range(0, len(kinds), 4096):  # a bounded block of trigrams at a time
        t = kinds[a : a + 4096]
        here = (rank >= a) & (rank < a + 4096) if len(kinds) > 4096 else slice(None)
        count = np.bincount(of[here] * len(t) + (rank[here] - a), minlength=len(low) * len(t)).reshape(len(low), len(t))
        out += count.astype(exact) @ (first[t // (k * k)] * second[t // k % k] * v[t % k]).astype(exact, copy=False)
    return out, has


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in chunks(batch, "text", 1 << 18):
        for a in range(0, part.num_rows, 128):
            yield part.slice(a, 128)


def learn_profiles(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS) -> DataFrame:
    """lang and v: the summed vectors of the rows where ``learn`` holds and the language isn't null, each text's whole length.

    Sums are whole numbers, so that their order doesn't matter. A task holds LANGUAGES sums at most before it sends them on.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])
        for batch in batches:
            for part in _blocks(batch):
                vectors, _ = bundle(part.column("text").to_pylist(), dims)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0)
                if len(total) > LANGUAGES:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.where(learn).where(docs[lang_col].isNotNull()).select(docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    sums = (
        rows.mapInArrow(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("d", "x"))
        .groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
        .select("lang", F.transform("v", lambda s: s["x"]).alias("v"))
    )
    return materialize(sums, "profiles")


def identify_language(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (cosine, 0 at least) for each row of ``docs``; ``profiles`` as learned.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Of equal cosines the
    first language by code point wins. Whole texts count; rows that repeat are answered one by one. No rows give no rows.
    Each block of LANGUAGES profiles takes a pass, which replaces a row's language where it has a larger cosine. Prototypes
    are rounded to whole numbers of length 2**20, so that every product is exact (for texts of under 2**28 letters) and a
    score depends neither on the block nor on the batch nor on the task that it is computed in.
    """
    low = -2.0  # below any cosine
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.lit("und").alias("lang_pred"), F.lit(low).alias("score"))
    learned = profiles.orderBy("lang").toLocalIterator()
    while block := list(itertools.islice(learned, LANGUAGES)):
        names = np.array([r["lang"] for r in block], object)
        vectors = np.array([r["v"] for r in block])
        m = np.rint(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12) * SCALE)
        length = np.maximum(np.sqrt((m * m).sum(axis=1)), 1)

        def predict(batches: Iterator[pa.RecordBatch], names=names, m=m, length=length) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _blocks(batch):
                    vectors, has = bundle(part.column("text").to_pylist(), m.shape[1])
                    cos = (vectors @ m.T) / length / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1)
                    best = cos.argmax(axis=1)
                    value, old = cos[np.arange(len(best)), best], part.column("score").to_numpy()
                    better = has & (value > old)
                    lang = np.where(better, names[best], np.array(part.column("lang_pred").to_pylist(), object))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(lang, pa.string()), pa.array(np.where(better, value, old))], ["doc_id", "text", "lang_pred", "score"])

        out = out.mapInArrow(predict, f"doc_id {kind}, text string, lang_pred string, score double")
    score = F.when(F.col("score") > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).otherwise(0.0)
    return out.select("doc_id", "lang_pred", score.alias("score"))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a row without id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
