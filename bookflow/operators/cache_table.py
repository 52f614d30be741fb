"""The cache as a table that lives between runs: bucketed by key, and rewritten only where a run has touched it.

The table is partitioned by a hash of the key and bucketed by the key. A save
reads and overwrites only the partitions of the new keys; a look-up joins on the
buckets, so the cache itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.operators.cache import upserted
from bookflow.operators.chains import with_checkpoints

PARTS, BUCKETS = 16, 4
SCHEMA = "cache_key string, corrected string, stamp long, part int"


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def create(spark: SparkSession, name: str) -> None:
    """An empty cache of that name, unless there is one."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], SCHEMA).write.format("parquet").partitionBy("part").bucketBy(BUCKETS, "cache_key").sortBy("cache_key").saveAsTable(name)


def save(spark: SparkSession, name: str, fresh: DataFrame) -> list[int]:
    """Takes `cache_key, corrected, stamp` into the cache, the latest of each key; rows without a key go nowhere. Gives the partitions that were rewritten.

    What is written is checkpointed first, as it is read from where it goes.
    """
    with_checkpoints(spark)
    new = fresh.filter("cache_key IS NOT NULL").select("cache_key", "corrected", F.col("stamp").cast("long").alias("stamp"))
    touched = sorted(r.part for r in new.select(_part(F.col("cache_key")).alias("part")).distinct().collect())  # PARTS numbers at most
    if not touched:
        return []
    old = spark.table(name).filter(F.col("part").isin(touched)).select("cache_key", "corrected", "stamp")
    merged = upserted(old, new).withColumn("part", _part(F.col("cache_key"))).checkpoint()
    dealt = merged.repartition(PARTS * BUCKETS, "part", "cache_key").select("cache_key", "corrected", "stamp", "part")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dealt.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    spark.catalog.refreshTable(name)
    return touched


def looked_up(blocks: DataFrame, key: Column, name: str) -> DataFrame:
    """`blocks` with `cache_key` and, where the cache knows it, `cached_text`. Only the blocks are shuffled, to the cache's buckets."""
    known = blocks.sparkSession.table(name).select("cache_key", F.col("corrected").alias("cached_text")).hint("merge")
    return blocks.withColumn("cache_key", key).join(known, "cache_key", "left")
