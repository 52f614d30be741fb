"""Connected components of a table of links, by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """From links `x, y` (longs): `node, label`, the least node that each can reach.

    A round gives each node the least label among its neighbours and itself, and
    then the label of that label, so the distance halves along chains. Labels
    are counted before they are shuffled; links never leave the executors, and
    each round's tables replace those of the round before.
    """
    both = written(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label"), F.lit(True).alias("changed")), "labels")
    while not labels.filter("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        met = written(labels.join(near, "node").select("node", F.least("label", "near").alias("low"), "label"), "labels")
        jump = met.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = written(met.join(jump, "low").select("node", F.col("lower").alias("label"), (F.col("lower") != F.col("label")).alias("changed")), "labels")
        forget(labels, met)
        labels = after
    forget(both)
    return labels.drop("changed")
