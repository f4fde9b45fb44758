"""Mixing sources to target weights by capped water-filling and seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count


def fill_targets(sources: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Share budget_share x all sizes among sources by weight; no target exceeds max_epochs x its source's size.

    ``sources``: source, source_size, weight (null or negative counts as 0). Adds target. Each round gives what is left
    to the sources that are not yet clamped, by weight, and clamps those that would exceed their cap; it ends when none
    does. Only sums over the sources' table come to the driver. Where all that have weight are full, the rest is unused.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rows = sources.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)).cast("double"), F.lit(0.0)))
    budget = float(budget_share) * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises; each round clamps one source more at least
        full = F.col("weight") * F.lit(level) >= cap
        x = rows.agg(
            F.sum(F.when(full, cap)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not x["open"]:
            break
        share = (budget - (x["used"] or 0.0)) / x["open"]
        if share <= level * (1 + 1e-12):
            break
        level = share
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def sample_order(seed: int, id_col: Column) -> Column:
    """The document's place in its source's seeded shuffle, as hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def mix_sources(
    docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
) -> DataFrame:
    """How often the mix takes each document.

    ``weights``: source, weight; a source without a row there has weight 0. Returns doc_id, source, size (words),
    source_size, target, repeats (int), taken (= size x repeats), a row for each row of ``docs``. A source's documents
    are all taken ``floor(target / source_size)`` times; for the fraction that remains, once more from the start of a
    seeded shuffle to where the words come nearest to the target. Only the block of the shuffle that holds this place is
    sorted. Null text has no words; null is a source of its own; rows that repeat an id stand beside each other.
    Documents without words take nothing. No rows give no rows. The same seed and rows give the same mix.
    """
    slim = materialize(
        docs.select(
            docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"),
            sample_order(seed, docs[id_col]).alias("place"),
        ).withColumn("block", F.substring("place", 1, 3)),
        "sizes",
    )
    blocks = materialize(slim.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    w = weights.select(F.col("source").alias("w_source"), F.col("weight").alias("weight"))
    sources = sources.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    filled = fill_targets(materialize(sources, "sources"), budget_share, max_epochs)

    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = filled.withColumn("whole", F.floor(epochs + F.lit(1e-12)).cast("int")).withColumn(
        "extra", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    before = F.sum("words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    cut = (
        blocks.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(plan.select(F.col("source").alias("p_source"), "extra"), F.col("source").eqNullSafe(F.col("p_source")))
        .where("before < extra").groupBy("source").agg(F.max(F.struct("block", "before")).alias("cut"))
        .select(F.col("source").alias("c_source"), F.col("cut.block").alias("cut_block"), F.col("cut.before").alias("cut_before"))
    )
    plan = materialize(plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "plan")
    plan = plan.withColumnRenamed("source", "p_source").drop("weight")

    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    at_cut = F.coalesce(F.col("block") == F.col("cut_block"), F.lit(False))
    sure = rows.where(~at_cut).withColumn("more", F.coalesce(F.col("block") < F.col("cut_block"), F.lit(False)).cast("int"))
    upto = F.col("cut_before") + F.sum("size").over(W.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    near = rows.where(at_cut).withColumn("more", (upto - F.col("size") / 2 <= F.col("extra")).cast("int"))
    return sure.unionByName(near).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("repeats"),
        (F.col("size") * (F.col("whole") + F.col("more"))).cast("long").alias("taken"),
    )


def ranked_weights(docs: DataFrame, cycle: tuple[float, ...], source_col: str = "source") -> DataFrame:
    """Weights for the sources of ``docs``: the cycle's numbers, repeating, by code point order, null last."""
    names = docs.groupBy(docs[source_col].alias("source")).agg(F.count("*").alias("rows")).drop("rows")
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1  # of sources, not of rows
    return names.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, cycle))), (place % len(cycle) + 1).cast("int")))
