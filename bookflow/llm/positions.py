"""Places in a total order over a whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.llm.common import forget, written

_PART = 33


def placed(df: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """`df` with `part` and `pos`, each row's place in the ascending order of `order`, from 0; written.

    Rows are dealt out by ranges and sorted in their range, and the ranges are
    counted; only these counts, a row for each range, are summed in one window.
    """
    ranges = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    here = written(ranges.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed-ranges")
    part = F.shiftright("at", _PART)
    sizes = here.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _PART) - 1))
    out = written(here.withColumn("part", part).join(sizes.select("part", before.alias("before")), "part").withColumn("pos", place).drop("at", "before"), "placed")
    forget(here)
    return out
