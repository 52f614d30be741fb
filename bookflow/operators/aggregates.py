"""Counters that are kept up from batch to batch, next to the event log that they come from.

Each batch adds its own counts in a partition of its number. A batch that runs
again replaces what it added, so nothing is counted twice, and no update reads
and writes back a shared total. Reading sums a few rows for each batch; where
there are no counters yet, it counts the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def counted(events: DataFrame, by: list[str], words: Column) -> DataFrame:
    """`by, n, words` of a batch of events; a count of words is taken from 0 to 100000, and what is none as 0."""
    fixed = F.floor(F.least(F.greatest(F.coalesce(words, F.lit(0.0)), F.lit(0.0)), F.lit(100000.0)))
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(fixed), F.lit(0)).cast("long").alias("words"))


def record(path: str, events: DataFrame, by: list[str], words: Column, number: int) -> None:
    """Puts the counts of batch `number` in place of any that it had."""
    counts = counted(events, by, words).withColumn("batch", F.lit(number).cast("long"))
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def totals(spark: SparkSession, path: str, by: list[str], log: DataFrame, words: Column) -> DataFrame:
    """`by, n, words` over all batches, or of the whole log where nothing has been recorded."""
    if not exists(spark, path):
        return counted(log, by, words)
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("words").cast("long").alias("words"))
