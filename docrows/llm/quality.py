"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

The model's symbols are bytes of UTF-8, its order is 5, and an n-gram is its bytes as a whole number. Counts, continuation
counts, discounts and probabilities are count joins on n-grams, sharded by Spark. Scoring by such joins would send each
document's distinct n-grams, which are 3.5 times its text (README); so the finished model goes to the executors instead, in
shards by the two bytes before the predicted one, so that all that a position needs is in one shard. A shard has SHARD rows
at most, besides the rows of a single pair of bytes and those of the shortest n-grams, of which there are 2^17; the number
of shards grows with the model. Each is a sorted file of the shared folder, which Spark brings to the executors; a task
reads one after the other for each piece of texts. Sums over shards give a document's perplexity. It is compared with a
quantile of its language's trusted texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, materialize

ORDER = 5
#: Rows of the model (n-grams and contexts) that a task holds at once, 16 bytes each.
SHARD = 3_000_000
#: Bytes of texts that meet all shards before the next ones are read.
PIECE = 4 << 20
#: Ids of trusted rows that may be broadcast, 8 bytes each; more are joined by a shuffle.
IDS = 2_000_000
#: Distinct n-grams that a counting task holds before it sends them on.
HELD = 4_000_000
#: A language's mean and quantile are drawn to those of all as if it had so many trusted rows more.
STEADY_ROWS = 50
#: A limit lies above its quantile of log perplexity by this over the square root of the rows that tell it.
MARGIN = 0.2


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, with zero bytes before a text's first; the text of each, and the texts' sizes."""
    size = np.diff(texts.offs)
    of = np.repeat(np.arange(len(size)), size)
    padded = np.zeros(len(texts.data) + (ORDER - 1) * len(size), np.uint64)
    at = np.arange(len(texts.data)) + (of + 1) * (ORDER - 1)
    padded[at] = texts.data
    code = padded[at]
    for k in range(1, ORDER):
        code |= padded[at - k] << np.uint64(8 * k)
    return code, of, size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new: list[tuple[np.ndarray, np.ndarray]] = []  # of texts since the last merge

    def merge() -> None:
        nonlocal keys, n
        keys, where = np.unique(np.concatenate([keys, *(k for k, _ in new)]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([n, *(m for _, m in new)]), minlength=len(keys)).astype(np.int64)
        new.clear()

    out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            new.append(np.unique(grams(Texts(part.column("text")))[0], return_counts=True))
            if sum(len(k) for k, _ in new) > max(len(keys), 1 << 18):
                merge()
            if len(keys) > HELD:
                yield out()
                keys, n = keys[:0], n[:0]
    merge()
    yield out()


def train(texts: DataFrame) -> DataFrame:
    """The model of a column ``text``: rows (kind, size, gram, x).

    kind 'p': log probability of the last byte of an n-gram of that size after its others; kind 'b': log of the weight that
    a context of that size leaves to the shorter one. Null texts are empty; without any text, all bytes are equally likely.
    """
    level = materialize(texts.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many bytes stand before it
        level = materialize(level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams")
        levels[k] = level
    lower, out = None, []
    for k in range(1, ORDER + 1):
        c = levels[k]
        n1, n2, n3, n4 = (x or 0 for x in c.agg(*(F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4))).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        # a discount of nothing would leave unseen bytes without probability, so small corpora get a tenth at least
        d1, d2, d3 = (min(max(i - (i + 1) * y * b / a, 0.1), float(i)) if a and n1 else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        after = F.shiftright("gram", 8)
        contexts = c.groupBy(after.alias("context")).agg(F.sum("n").alias("total"), F.sum(less).alias("freed")).select(
            "context", "total", (F.col("freed") / F.col("total")).alias("left")
        )
        p = c.withColumn("context", after).join(contexts, "context")
        if lower is None:
            p = p.withColumn("under", F.lit(1 / 256))
        else:
            p = p.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower, "suffix")
        p = materialize(p.select("gram", ((F.col("n") - less) / F.col("total") + F.col("left") * F.col("under")).alias("p")), "model")
        lower = p.select(F.col("gram").alias("suffix"), F.col("p").alias("under"))
        row = lambda df, kind, size, gram, x: df.select(F.lit(kind).alias("kind"), F.lit(size).alias("size"), F.col(gram).alias("gram"), F.log(x).alias("x"))
        out += [row(p, "p", k, "gram", "p"), row(contexts, "b", k - 1, "context", "left")]
    return materialize(reduce(DataFrame.unionByName, out), "model")


class Shard:
    """A part of the model as sorted arrays, from a table in the order of its levels (kind and size) and n-grams."""

    def __init__(self, rows: pa.Table):
        level, gram, x = (rows.column(c).to_numpy() for c in ("level", "gram", "x"))
        gram = gram.view(np.uint64)
        ends = np.searchsorted(level, np.arange(2 * (ORDER + 1) + 1))
        of = lambda k, s: slice(ends[k * (ORDER + 1) + s], ends[k * (ORDER + 1) + s + 1])
        self.tables = {(kind, s): (gram[of(k, s)], x[of(k, s)]) for k, kind in enumerate("bp") for s in range(ORDER + 1)}

    def _find(self, kind: str, size: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, x = self.tables[kind, size]
        if not len(keys):
            return np.zeros(len(code), bool), np.zeros(len(code))
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return keys[at] == code, x[at]

    def score(self, code: np.ndarray) -> np.ndarray:
        """log probability of the last byte of each n-gram after its others."""
        total, open_ = np.zeros(len(code)), np.arange(len(code))
        for k in range(ORDER, 0, -1):
            mine = code[open_] & np.uint64((1 << 8 * k) - 1)
            found, x = self._find("p", k, mine)
            total[open_[found]] += x[found]
            open_, mine = open_[~found], mine[~found]
            if not len(open_):
                return total
            found, x = self._find("b", k - 1, mine >> np.uint64(8))
            total[open_[found]] += x[found]
        total[open_] += np.log(1 / 256)
        return total


def read_shard(name: str) -> Shard:
    """A shard by the name of its file, which Spark has brought here."""
    none = pa.table({"level": pa.array([], pa.int8()), "gram": pa.array([], pa.int64()), "x": pa.array([], pa.float64())})
    return Shard(pq.read_table(SparkFiles.get(name)) if name else none)


def shard_files(model: DataFrame) -> tuple[list[int], list[str]]:
    """The first pair of bytes of each shard, and the names of the files that Spark brings to the executors, by shard."""
    spark = model.sparkSession
    previous = F.when((F.col("kind") == "p") & (F.col("size") >= 3), F.shiftright("gram", 8)).when((F.col("kind") == "b") & (F.col("size") >= 2), F.col("gram"))
    pair = previous.bitwiseAND(F.lit(0xFFFF)).cast("int")
    per = np.zeros(1 << 16, np.int64)
    for r in model.select(pair.alias("b")).where("b IS NOT NULL").groupBy("b").count().collect():  # 65,536 rows at most
        per[r["b"]] = r["count"]
    begins, filled = [0], 0
    for b, n in enumerate(per.tolist()):
        if filled and filled + n > SHARD:
            begins.append(b)
            filled = 0
        filled += n
    of_pair = spark.createDataFrame([(b, int(k)) for b, k in enumerate(np.searchsorted(begins, np.arange(1 << 16), "right") - 1)], "pair int, shard int")
    one = model.withColumn("pair", pair)
    every = one.where("pair IS NULL").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(len(begins) - 1))))
    level = (F.when(F.col("kind") == "p", ORDER + 1).otherwise(0) + F.col("size")).cast("byte")
    rows = one.join(F.broadcast(of_pair), "pair").unionByName(every, allowMissingColumns=True).select("shard", level.alias("level"), "gram", "x")
    table = materialize(rows.repartitionById(len(begins), F.col("shard")).sortWithinPartitions("level", "gram"), "shards", keep=True)  # executors that come later fetch it too
    names: list[str] = [""] * len(begins)
    for path in table.inputFiles():
        spark.sparkContext.addFile(path)
        name = path.rsplit("/", 1)[-1]
        names[int(re.match(r"part-(\d+)", name)[1])] = name
    return begins, names


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", name: str = "mean_log", shards: tuple[list[int], list[str]] | None = None) -> DataFrame:
    """``docs`` with one column more: mean log probability of a text's bytes; null where it has none. No text is shuffled.

    One pass of one Python worker for each task, however many shards the model has: PIECE bytes of texts, or one longer text,
    meet one shard after the other, so that a task holds one shard at a time. ``shards``: those of the model, if they are
    made already. Their files stay for as long as the session.
    """
    begins, names = shards or shard_files(model)
    shard_of = (np.searchsorted(begins, np.arange(1 << 16), "right") - 1).astype(np.uint16)
    sums = "__log_sum"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Shard] = {}  # one at most
        for batch in batches:
            for piece in chunks(batch, text_col, PIECE if len(names) > 1 else 1 << 20):
                code, of, size = grams(Texts(piece.column(text_col)))
                got = np.zeros(len(size))
                if len(names) > 1:
                    of_shard = shard_of[((code >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)]
                    order = np.argsort(of_shard, kind="stable")
                    ends = np.searchsorted(of_shard[order], np.arange(len(names) + 1))
                else:
                    order, ends = np.arange(len(code)), np.array([0, len(code)])
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    if k not in held:
                        held.clear()
                        held[k] = read_shard(names[k])
                    for a in range(ends[k], ends[k + 1], 1 << 20):
                        own = order[a : min(a + (1 << 20), ends[k + 1])]
                        got += np.bincount(of[own], weights=held[k].score(code[own]), minlength=len(size))
                yield piece.append_column(sums, pa.array(got))

    shape = docs.withColumn(sums, F.lit(0.0)).schema
    bytes_ = F.octet_length(text_col)
    return docs.mapInArrow(add, shape).withColumn(name, F.when(bytes_ > 0, F.col(sums) / bytes_)).drop(sums)


def near(ids: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is among ``ids``; few ids are broadcast, so that the texts stay where they are."""
    few = ids.limit(IDS + 1).count() <= IDS
    return rows.join(F.broadcast(ids) if few else ids, id_col, "left_semi")


def calibration(id_col: Column) -> Column:
    """A fourth of the trusted documents, by id; thresholds are taken from them and counts from the others."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 3, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.995, margin: float = MARGIN, steady: float = 300.0,
) -> DataFrame:
    """``docs`` with perplexity, limit and rejected.

    Trusted are the documents with quality 1 in ``labels`` (doc_id, quality). Three quarters of them are counted, and the
    others tell the limits. One rule holds for all sizes: a language's mean log perplexity, and the ``quantile`` of how far
    its texts lie above it, are drawn to those of all languages as if it had STEADY_ROWS rows more, and the limit lies
    above by ``margin`` over the square root of its rows and those. So a language of many rows has its own quantile, about
    1 in 200 of them above, and one without rows, or null, that of all. Perplexity is per byte; a short text's is drawn to
    its language's mean, as if it had ``steady`` bytes more, as a few words tell little. A text that is null or empty has
    no perplexity and isn't rejected; without trusted texts none is. Rows that repeat are answered one by one; no rows give no rows. Columns of ``docs``
    that bear these three names are replaced.
    """
    docs = docs.drop("perplexity", "limit", "rejected", "mean_log")
    ids = materialize(labels.where("quality = 1").select(F.col("doc_id").alias(id_col)).distinct(), "trusted")
    trusted = near(ids, docs.select(F.col(id_col), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), id_col)
    aside = calibration(F.col(id_col))
    model = train(trusted.where(~aside).select("text"))
    shards = shard_files(model)
    held = materialize(score(trusted.where(aside), model, shards=shards).where("mean_log IS NOT NULL").select("lang", "mean_log", F.octet_length("text").alias("n")), "held")

    weight = F.sum(F.col("mean_log") * F.col("n")) / F.sum("n")
    every = held.agg(weight.alias("mean")).first()["mean"]
    every = 0.0 if every is None else every
    n = F.col("rows")
    drawn_to = lambda own, all_: (n * own + STEADY_ROWS * all_) / (n + STEADY_ROWS)
    mean = held.where("lang IS NOT NULL").groupBy("lang").agg(weight.alias("own"), F.count("*").alias("rows")).select("lang", "rows", drawn_to(F.col("own"), F.lit(every)).alias("mean"))
    drawn = lambda n: (F.col("mean_log") * n + F.coalesce("mean", F.lit(every)) * steady) / (n + steady)
    above = held.join(mean, "lang", "left").select("lang", (F.coalesce("mean", F.lit(every)) - drawn(F.col("n"))).alias("above"))
    at = F.percentile_approx("above", F.lit(quantile), F.lit(10_000))
    all_above = above.agg(at).first()[0]  # null without trusted texts, and then so are all limits
    own = above.where("lang IS NOT NULL").groupBy("lang").agg(at.alias("above"))
    limit = lambda mean, above, rows: F.exp(-mean + above + margin / F.sqrt(rows + STEADY_ROWS))
    known = F.lit(all_above).cast("double")
    limits = mean.join(own, "lang").select(F.col("lang").alias("__lang"), "mean", limit(F.col("mean"), drawn_to(F.col("above"), known), n).alias("limit"))
    limits = materialize(limits, "limits")  # a row for each language
    all_limit = limit(F.lit(every), known, F.lit(0))

    scored = score(docs, model, text_col, shards=shards).join(F.broadcast(limits) if limits.count() <= 10_000 else limits, F.col(lang_col) == F.col("__lang"), "left")
    scored = scored.withColumn("perplexity", F.exp(-drawn(F.octet_length(text_col)))).withColumn("limit", F.coalesce("limit", all_limit))
    return scored.withColumn("rejected", F.coalesce(F.col("perplexity") > F.col("limit"), F.lit(False))).drop("__lang", "mean", "mean_log")
