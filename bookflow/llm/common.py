"""Shared helpers of the training-data operators: scratch tables and word rules."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of 1000 whole texts, unless it sets another number itself: workers hold a few MB of text at a time."""
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_ROWS)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`. Where it is unset, a temporary one if all of Spark is one local process, else an error, as executors elsewhere couldn't read it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="bookflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Of Parquet files whose rows are large: their row groups hold about 8 MB, and one row at least. Both a writer and a reader, whose batches end where a row group does, hold one of these at a time and not the 128 MB or 4096 rows of the default.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def trim_memory() -> None:
    """Gives what this worker has freed back to the system: it stays for later tasks, beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def written(df: DataFrame, name: str, by: str | None = None, large_rows: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    It cuts the lineage, so a lost executor costs a re-read of finished files
    and not a second run of all that came before. The shuffle files of the
    write go with it: the table has replaced them. Rows of each value of `by`
    have a folder of their own, which `forget` can remove alone. `large_rows`
    are read a few at a time.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.options(**LARGE_ROWS) if large_rows else df.write
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame, part: str = "") -> None:
    """Removes tables of `written`, or the folder `part` of them, that nothing reads any more: what was made of them is written too."""
    for one in tables:
        spark = one.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{one.scratch_path}/{part}".rstrip("/"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def often_seen(batches: Iterator[pa.RecordBatch], items_of: Callable[[str], Iterable[str]], least: int, group: int = 5_000) -> Iterator[pa.RecordBatch]:
    """`item, n` of the items that at least `least` of some `group` documents in a row hold; the batches' first column has the texts."""
    seen: Counter = Counter()
    docs = 0

    def out() -> pa.RecordBatch:
        many = {k: n for k, n in seen.items() if n >= least}
        return pa.RecordBatch.from_arrays([pa.array(list(many), pa.string()), pa.array(list(many.values()), pa.int64())], names=["item", "n"])

    for batch in batches:
        for cell in batch.column(0):
            seen.update(items_of(cell.as_py() or ""))
        docs += batch.num_rows
        if docs >= group:
            yield out()
            seen, docs = Counter(), 0
    yield out()


def word_count(text: Column) -> Column:
    """The number of words, in the JVM; 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, whole, in a session with small Arrow batches."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
