"""Removal of duplicate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import cell, public


def record_key(columns: tuple[str, ...] = ()) -> Column:
    """What makes records equal: the key fields (a missing one is null), or all public entries in the order of their names."""
    return F.struct(*(cell("entries", c).alias(f"k{i}") for i, c in enumerate(columns))) if columns else F.sort_array(public("entries"))


def key_digest(columns: tuple[str, ...] = ()) -> Column:
    """128 bits of the key, as it is written in JSON, which tells apart all that the key does; 0.0 and -0.0 are alike."""
    same = lambda v: F.struct(v["t"].alias("t"), v["s"].alias("s"), (v["n"] + 0.0).alias("n"))
    key = F.array(*(same(cell("entries", c)) for c in columns)) if columns else F.transform(record_key(), lambda e: F.struct(e["k"].alias("k"), same(e["v"]).alias("v")))
    return F.unhex(F.md5(F.to_json(key, {"ignoreNullFields": "false"}).cast("binary")))


def deduplicate(records: DataFrame, columns: tuple[str, ...] = (), keep: str = "first") -> DataFrame:
    """One record for each key, at the first one's place; ``keep='last'`` takes the last one's content there.

    Groups are aggregated by a digest of their key before they are shuffled, so that a key that very many records share costs
    no more than others, and each record is sent once.
    """
    place = F.shiftleft(F.col("file_ord").cast("long"), 32) + F.col("rec_ord")
    own = [c for c in records.columns if c not in ("file_ord", "rec_ord")]
    pick = F.max_by if keep == "last" else F.min_by
    groups = records.groupBy(key_digest(columns).alias("__key")).agg(F.min(place).alias("__at"), pick(F.struct(*own), place).alias("__row"))
    at = {"file_ord": F.shiftright("__at", 32).cast(records.schema["file_ord"].dataType), "rec_ord": F.col("__at").bitwiseAND((1 << 32) - 1).cast(records.schema["rec_ord"].dataType)}
    return groups.select("__row.*", *(v.alias(k) for k, v in at.items())).select(records.columns)
