"""How many requests a service takes at once and how far apart: a table of policies, and planned starts that all tasks keep to."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Requests at once (what is used where nothing is asked for, the least and the most) and milliseconds between waves, by service, tier and whether it translates.
POLICIES = [
    ("gemini", "paid", False, 3, 1, 4, 150), ("gemini", "paid", True, 1, 1, 1, 300), ("gemini", "free", False, 1, 1, 1, 3800), ("gemini", "free", True, 1, 1, 1, 3800),
    ("groq", "paid", False, 3, 1, 4, 150), ("groq", "paid", True, 1, 1, 1, 300), ("groq", "free", False, 1, 1, 1, 1200), ("groq", "free", True, 1, 1, 1, 2100),
    ("fast", "free", False, 2, 1, 3, 400), ("fast", "free", True, 1, 1, 1, 800), ("other", "free", False, 1, 1, 1, 1500), ("other", "free", True, 1, 1, 1, 2000),
]
#: A paid service translates so many at once where no context rolls from one request to the next.
WITHOUT_CONTEXT = 2


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "service string, tier string, translates boolean, parallel int, least int, most int, pause_ms int")


def allowed(requests: DataFrame, asked: Column, rolls: Column) -> DataFrame:
    """`requests` (with `service, tier, translates`) and `at_once, pause_ms`. `asked` is the number a user asks for, or null or 0; `rolls` whether context rolls on. A service or tier that the table lacks has the policy of `other`, or of its free tier."""
    rules = F.broadcast(table(requests.sparkSession))  # a dozen rows
    named = requests.withColumns({"_service": F.when(F.col("service").isin("gemini", "groq", "fast"), F.col("service")).otherwise("other")})
    named = named.withColumn("_tier", F.when(F.col("_service").isin("gemini", "groq") & (F.col("tier") == "paid"), "paid").otherwise("free"))
    met = named.join(rules.select(F.col("service").alias("_service"), F.col("tier").alias("_tier"), "translates", "parallel", "least", "most", "pause_ms"), ["_service", "_tier", "translates"])
    wanted = F.greatest(F.col("least"), F.least(F.coalesce(F.nullif(asked, F.lit(0)), F.col("parallel")), F.col("most")))
    both = F.col("translates") & (F.col("_tier") == "paid") & ~rolls
    return met.withColumn("at_once", F.when(both, WITHOUT_CONTEXT).otherwise(wanted).cast("int")).drop("_service", "_tier", "parallel", "least", "most")


def planned(requests: DataFrame, service: list[str], group: str, order: str) -> DataFrame:
    """`requests` (with `at_once, pause_ms`) and `slot, wave, start_ms`: when each may start, counted from the run's start.

    The requests of a service are numbered over all its groups in their order: in
    each group by a window, and over groups by their sizes, so no task holds all
    requests of a service. A wave has `at_once` requests, `pause_ms` after the last.
    """
    sizes = requests.groupBy(*service, group).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*service).orderBy(group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each group
    offsets = sizes.select(*service, group, before.alias("before"))
    inside = F.row_number().over(W.partitionBy(*service, group).orderBy(order)) - 1
    rows = requests.withColumn("inside", inside).join(offsets, [*service, group]).withColumn("n", F.col("before") + F.col("inside"))
    wave = F.floor(F.col("n") / F.col("at_once"))
    return rows.withColumns({"slot": (F.col("n") % F.col("at_once")).cast("int"), "wave": wave, "start_ms": wave * F.col("pause_ms")}).drop("inside", "before", "n")


def kept_to(requests: DataFrame, model: Callable[[str], str], schema: str, began: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """`answer` of each of `requests` (`request, start_ms`, and the columns of `schema`), none called before `began` plus its planned start, whichever task it is in. Tasks take requests in the order of their starts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for request, start in zip(frame["request"], frame["start_ms"], strict=True):
                wait = began + start / 1000 - clock()
                if wait > 0:
                    sleep(wait)
                answers.append(model(request))
            yield frame.assign(answer=answers)[[c.split()[0] for c in schema.split(", ")] + ["answer"]]

    return requests.sortWithinPartitions("start_ms").mapInPandas(run, f"{schema}, answer string")
