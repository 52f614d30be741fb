"""Blocks and counters as streams, with the functions of the batch side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from bookflow.functions.literal_rules import clean_literal, has_anomaly
from bookflow.operators.cache import with_cached


def read_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def cleaned(blocks: DataFrame, text: str) -> DataFrame:
    """A stateless stream: the literal rules and the anomaly flag."""
    return blocks.withColumn("cleaned", clean_literal(F.col(text))).withColumn("has_anomaly", has_anomaly(F.col("cleaned")))


def counters(events: DataFrame, action: Column, words: Column) -> DataFrame:
    """Running totals by action. An event log and an aggregate lose no update, as reading, adding and writing back could."""
    fixed = F.least(F.greatest(F.coalesce(words, F.lit(0.0)), F.lit(0.0)), F.lit(100000.0))
    return events.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(fixed)).cast("long").alias("words"))


def windowed_counters(events: DataFrame, time: str, action: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by action in windows of event time; rows later than `late` are left out. An addition of this library."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), action).agg(F.count(F.lit(1)).alias("n"))


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch as Parquet in a folder of its number, so one that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumed(blocks: DataFrame, key: Column, corrections: DataFrame) -> DataFrame:
    """A stream of blocks with what the table of corrections has for them: a block that is known isn't asked for again. The table is read anew for each micro-batch."""
    return with_cached(blocks, key, corrections)


def rolling_context(blocks: DataFrame, book: str, order: str, text: str, last: int = 3, chars: int = 300) -> DataFrame:
    """`book, ord, text, before`: each block with the `last` texts of its book before it, which the stream keeps as state; blocks of one micro-batch are taken in their order."""
    rows = blocks.select(F.col(book).cast("string").alias("book"), F.col(order).cast("long").alias("ord"), F.col(text).alias("text"))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(frames)).sort_values("ord").itertuples(index=False):
            out.append((key[0], row.ord, row.text, list(held)))
            held = [*held, (row.text or "")[:chars]][-last:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["book", "ord", "text", "before"])

    return rows.groupBy("book").applyInPandasWithState(fold, "book string, ord long, text string, before array<string>", "held array<string>", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Calls `tell` with the rows of each finished micro-batch, so far and now."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell, self.total = tell, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += event.progress.numInputRows
        self.tell(self.total, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def cancel(query: StreamingQuery, wait: float = 30.0) -> bool:
    """Stops a stream after the micro-batch at hand; its checkpoint lets it go on later. Whether it has ended."""
    query.stop()
    return bool(query.awaitTermination(wait)) or not query.isActive
