"""The table of finished corrections: look-up, upsert, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import round_half_up

KB_PER_ENTRY = 1.2


def with_cached(blocks: DataFrame, key: Column, corrections: DataFrame) -> DataFrame:
    """`blocks` with `cache_key` and, where known, `cached_text`. Equal keys are looked up once: the corrections have one row a key."""
    return blocks.withColumn("cache_key", key).join(corrections.select("cache_key", F.col("corrected").alias("cached_text")), "cache_key", "left")


def upserted(corrections: DataFrame, fresh: DataFrame) -> DataFrame:
    """`cache_key, corrected, stamp`: of each key the entry of the latest stamp, ties by text. Aggregated before the shuffle."""
    both = corrections.unionByName(fresh)
    return both.groupBy("cache_key").agg(F.max(F.struct("stamp", "corrected")).alias("e")).select("cache_key", "e.corrected", "e.stamp")


def stats(corrections: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return corrections.agg(n.alias("entries"), round_half_up(n * KB_PER_ENTRY).cast("long").alias("size_kb"))
