"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries, one for each task, find frequent digests. An exact count verifies them, and the winners (at most
``slots`` rows) are broadcast, so that their rows are decided where they are read. All other digests use an ordinary shuffle,
in which each digest is aggregated before it is sent; the rows of digests that repeat meet their group's least id by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Counters of a Misra-Gries summary, and the most rows that are broadcast (about 70 bytes each).
SLOTS = 2048
#: Repeated digests that may be broadcast (about 100 bytes each); more are joined by a shuffle.
FEW = 200_000


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def misra_gries(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """At most ``slots`` digests of a task with counters; a counter is too low by at most rows / (slots + 1)."""
    held: dict[bytes, int] = {}
    for batch in batches:
        for pair in batch.column(0).value_counts().to_pylist():
            held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > 8 * slots:
                held = _shrink(held, slots)
    held = _shrink(held, slots)
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "n"])


def _shrink(held: dict[bytes, int], slots: int) -> dict[bytes, int]:
    """Merging step of mergeable summaries: take the (slots + 1)-th counter from all and keep what is left above zero."""
    if len(held) <= slots:
        return held
    less = sorted(held.values(), reverse=True)[slots]
    return {k: v - less for k, v in held.items() if v > less}


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Decide for each row of ``docs`` whether it stays; of equal texts the row with the smallest id does.

    Returns doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256, a row for each row of ``docs``; other
    columns are not read. Texts are equal after each run of white space is one space; null is the empty text. Ids name
    documents: rows that repeat an id and text count in group_size and share the decision. A row without id never stays
    beside one with an id; where no row has an id, keep_id is null and none is marked as kept. No rows give no rows.
    """
    sha = F.sha2(normal_text(docs[text_col]).cast("binary"), 256)
    rows = materialize(docs.select(docs[id_col].alias("doc_id"), F.unhex(sha).alias("digest")), "digests")

    frequent = (
        rows.select("digest")
        .mapInArrow(lambda it: misra_gries(it, slots), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest").limit(slots)  # whatever has over 2 / (slots + 1) of the rows is among these
        .select("digest")
    )
    group = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = materialize(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*group).where("group_size > 1"), "winners")

    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti")
    repeated = materialize(rest.groupBy("digest").agg(*group).where("group_size > 1"), "repeated")
    repeated = F.broadcast(repeated) if repeated.limit(FEW + 1).count() <= FEW else repeated
    alone = F.col("group_size").isNull()
    light = rest.join(repeated, "digest", "left").select(
        "digest", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
