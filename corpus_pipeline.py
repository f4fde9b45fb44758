"""Corpus pipeline: five stages, each written as Parquet and read again before the next.

Each stage works on all that its predecessor kept and decides on its own input. All but the last return the columns of
``documents``; the last adds ``copy``, as the mix can take a document more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrows.llm.common import WORD, materialize, own_tables
from docrows.llm.decontaminate import find_leaks
from docrows.llm.line_dedup import line_dedup
from docrows.llm.mixing import mix_sources, ranked_weights
from docrows.llm.near_dedup import near_dedup
from docrows.llm.quality import classify

#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
FEW = 2_000_000
#: Weights of the sources, by code point order of their names, repeating; the mix's size; most repetitions.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2.0


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ``ids``; a row without an id stays."""
    ids = materialize(ids.select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct(), "ids")
    few = ids.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__id"), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("NOT rejected").select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, short ones if they are the same, and documents that lose all their words by that."""
    out = line_dedup(docs, short_exact=True)
    left = (F.size("removed") == 0) | F.col("kept_text").rlike(WORD)
    n_chars = F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return out.where(left).withColumn("n_chars", n_chars).withColumn("text", F.col("kept_text")).select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the smallest id stays."""
    return _without(docs, near_dedup(docs, shingle=5, similarity=0.8).where("NOT kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never; ``copy`` counts from 1."""
    mix = mix_sources(docs, ranked_weights(docs, WEIGHTS), budget_share=SHARE, max_epochs=EPOCHS)
    take = mix.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source")).agg(F.max("repeats").alias("__repeats")).where("__repeats > 0")
    both = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
    return docs.join(take, both).select(*docs.columns, F.explode(F.sequence(F.lit(1), "__repeats")).alias("copy"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]
#: The stages score with a trained model and choose by hashes, which SQL can't express; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with own_tables(spark):  # what the stage wrote on the way goes
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
