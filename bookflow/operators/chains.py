"""Chains of starts: each row names the next, and those count that the first one reaches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> None:
    """Sees that tables can be checkpointed: in `spark.checkpoint.dir`, or a temporary folder where it is unset and all of Spark is one local process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="bookflow-")
    context.setCheckpointDir(where)


def kept(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read back: computed once, where checkpoint() would compute it twice."""
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reached(nodes: DataFrame, key: str) -> DataFrame:
    """`key, node` of the nodes that each key's least node reaches, of `key, node, next` (null at the end; `next` is larger than `node`).

    Pointer doubling: round k adds what is 2^k steps on from the nodes found so
    far, so a chain of n starts takes log2(n) rounds of joins by key and node,
    and no key's chain is ever in one task. It ends where a round finds nothing,
    as nothing is then further on.
    """
    with_checkpoints(nodes.sparkSession)
    every = kept(nodes.select(key, "node", "next"))
    jumps = every.filter("next IS NOT NULL")
    found = every.groupBy(key).agg(F.min("node").alias("node"))
    while True:
        more = kept(found.join(jumps, [key, "node"]).select(key, F.col("next").alias("node")))
        if more.isEmpty():
            return found
        found = found.union(more)
        twice = jumps.select(key, F.col("node").alias("next"), F.col("next").alias("far"))
        jumps = kept(jumps.join(twice, [key, "next"]).select(key, "node", F.col("far").alias("next")))
