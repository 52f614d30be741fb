"""Operator 9: remove word windows that occur earlier, by level-wise doubling.

Level 1 looks at runs of half the window. Of the runs inside each window only
the one with the least hash is listed: equal windows hold equal runs, so they
list the same one, and a run that is listed once in the whole corpus can't be
part of a repeated window. That is about a sixth of all runs and loses nothing.
Only windows whose listed run is repeated are extended to twice the length, and
level 2 compares these by two hashes of 64 bits, both made of 64-bit hashes of
words, of which two different ones would have to agree. There it ends: whatever repeats at a
greater length is already covered by its windows.

Documents with the same words as one of a smaller doc_id are set aside first:
each of their windows is earlier there. A document's windows are emitted once
each, so all keys are counted before they are shuffled, and the joins read
written tables, where adaptive execution can split a hot key.

Defined cases: a null text has no words; texts shorter than a window keep all
of them; windows are judged on the input alone; a null doc_id counts as later
than all others; rows that share a doc_id are each judged against smaller
doc_ids and against themselves, so repeated rows get equal results; an empty
table gives an empty one; other columns of the input aren't carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import table, written
from bookflow.llm.wordhash import anchors, runs, sliding, word_hashes

WINDOW = 20
_LAST = (1 << 63) - 1
_ROWS = 100_000
_NOTHING = hashlib.sha256(b"").hexdigest()


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).cast("binary").alias("text"))


def listed_runs(docs: DataFrame, window: int) -> DataFrame:
    """Level 1: `row, doc_id, id, content, n_words, sha, listed` for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, found, ends = [], [], [], [0]
            for cell in batch.column(4):
                raw = cell.as_py() or b""
                ws = raw.split()
                counts.append(len(ws))
                shas.append(_digest(ws))
                if len(ws) >= window:
                    base = runs(word_hashes(raw), window // 2)
                    found.append(base[anchors(base, window - window // 2 + 1)[1]])
                    ends.append(ends[-1] + len(found[-1]))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64()), pa.array(shas, pa.string()), lists], names=["row", "doc_id", "id", "content", "n_words", "sha", "listed"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "id", "content", "text").mapInArrow(run, "row long, doc_id long, id long, content long, n_words long, sha string, listed array<long>")


def _candidates(raw: bytes, repeated: pa.ListScalar, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the starts of windows whose listed run is repeated."""
    one = word_hashes(raw)
    least = sliding(runs(one, window // 2), window - window // 2 + 1, np.minimum)
    return one, np.flatnonzero(np.isin(least, repeated.values.to_numpy().view(np.uint64)))


def windows(candidates: DataFrame, window: int) -> DataFrame:
    """Level 2: `a, b, id, row, start` of each different candidate window of each document, at its first start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for row, key, text, repeated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                one, starts = _candidates(text.as_py(), repeated, window)
                a, first = np.unique(runs(one, window)[starts], return_index=True)
                b = runs(one, window, 1)[starts[first]]
                held.append((a.view(np.int64), b.view(np.int64), np.full(len(a), key), np.full(len(a), row), starts[first]))
                n += len(a)
                if n > _ROWS:
                    yield _flat(held)
                    held, n = [], 0
            if held:
                yield _flat(held)

    return candidates.select("row", "id", "text", "repeated").mapInArrow(run, "a long, b long, id long, row long, start long")


def _flat(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["a", "b", "id", "row", "start"])


def kept(candidates: DataFrame, later: DataFrame, window: int) -> DataFrame:
    """`row, n_removed, kept_sha` of the candidate documents, given the starts in `later` that are earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, removed, shas = batch.column(0), [], []
            for text, repeated, elsewhere in zip(*batch.columns[1:], strict=True):
                raw = text.as_py()
                one, starts = _candidates(raw, repeated, window)
                _, first = np.unique(runs(one, window)[starts], return_index=True)
                out = np.ones(len(starts), bool)
                out[first] = False
                gone = np.concatenate([starts[out], elsewhere.values.to_numpy() if elsewhere.is_valid else starts[:0]])
                covered = np.zeros(len(one) + 1, np.int64)
                np.add.at(covered, gone, 1)
                np.add.at(covered, gone + window, -1)
                left = covered.cumsum()[:-1] == 0
                removed.append(int(len(left) - left.sum()))
                shas.append(_digest(list(compress(raw.split(), left.tolist()))))
            yield pa.RecordBatch.from_arrays([rows, pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["row", "n_removed", "kept_sha"])

    both = candidates.select("row", "text", "repeated").join(later, "row", "left")
    return both.mapInArrow(run, "row long, n_removed long, kept_sha string")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` for each row of `docs`; `window` must be even."""
    keyed = _keyed(docs, doc_id, text)
    base = written(listed_runs(keyed, window), "dedup-documents")
    firsts = written(base.groupBy("sha").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("sha"), F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "dedup-texts")
    alone = written(base.select("row", "listed").join(firsts.select(F.col("first_row").alias("row")), "row", "left_semi"), "dedup-runs").select("row", F.explode("listed").alias("run"))
    repeated_runs = written(alone.groupBy("run").count().filter("count > 1").select("run"), "dedup-repeated")
    hits = alone.join(repeated_runs, "run").groupBy("row").agg(F.collect_set("run").alias("repeated"))
    marked = written(hits.join(base.select("row", "id", "content"), "row"), "dedup-marked")
    candidates = written(keyed.select("id", "content", "text").join(marked, ["id", "content"]).select("row", "id", "text", "repeated"), "dedup-candidates")
    level = windows(candidates, window)
    earliest = written(level.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("a", "b", "least"), "dedup-windows")
    later = level.join(earliest, ["a", "b"]).filter("id > least").groupBy("row").agg(F.collect_set("start").alias("elsewhere"))
    results = written(kept(candidates, later, window).dropDuplicates(["row"]).withColumnRenamed("row", "of_row"), "dedup-kept")
    own = F.when(F.col("id") == F.col("first_id"), F.col("first_row")).otherwise(-1 - F.col("row"))
    joined = base.select("row", "doc_id", "id", "n_words", "sha").join(firsts, "sha").withColumn("of_row", own).join(results, "of_row", "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= window)
    return joined.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM texts),
windows AS (SELECT doc_id, n, p, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS w FROM words),
placed AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS place FROM windows WHERE p <= n - 19),
marked AS (
  SELECT w.doc_id, w.p, w.word, max(g.p) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN placed g ON g.doc_id = w.doc_id AND g.p = w.p AND g.place > 1),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
