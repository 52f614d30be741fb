"""Blocks from the test tables: each line of a document is one. Queries that repair first damage them, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, by: str) -> DataFrame:
    """`df` over all cores by a hash of `by`, where it has fewer partitions than cores: a file of one row group is one task, whatever its queries do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if df.rdd.getNumPartitions() < cores else df


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, lang, source, block_no, original_text`."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("block_no", "original_text"))


def damaged(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(". "), F.lit(" . ")), F.lit(", "), F.lit(" ,, "))


BLOCKS = """blocks AS (
  SELECT doc_id, lang, source, unnest(range(len(parts)))::INT AS block_no, unnest(parts) AS original_text
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))"""
DAMAGED = "replace(replace(original_text, '. ', ' . '), ', ', ' ,, ')"
