"""Operator 3: exact top-k inner products through a pivot-distance index.

Vectors are keyed by their nearest pivot and, within it, by a ring of distances.
Of each ring the index keeps its rows, its distances' range and its largest
norm; there are at most PIVOTS * RINGS rings of a dimension, so that table is
bounded. By the triangle inequality a query at distance d of the pivot is at
least max(0, d - outer, inner - d) away from all in a ring, and |q - x|^2 =
|q|^2 + |x|^2 - 2 q.x turns this into the most that an inner product can be.

A query goes to its rings from the best bound down. The first few give it its
k-th best score; the others are searched only while their bound reaches that.
A ring's rows are cut into blocks of bounded size, so equal vectors, which all
fall into one ring, are many blocks. Blocks of queries meet blocks of rows.

Pivots and ring edges are fitted to a sample of at most SAMPLE rows; every row
is indexed, and the result is exact whatever the pivots are.

Defined cases: a vector that is null or empty, or holds a null or a number that
isn't finite, takes no part, nor does a row without id; only vectors of the same
length meet; rows that share the query's id count as its own; repeated query
rows each get results, and repeated other rows are each a candidate; fewer than
k candidates give fewer rows; an empty table gives an empty one; scores are
exact below 2^53. Other columns of the input aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.llm.common import table, written

SAMPLE, PIVOTS, RINGS, FIRST_RINGS = 4096, 32, 8, 4
QUERY_BLOCK, LEAST_BLOCK, MOST_BLOCK = 128, 64, 4096


def whole_vectors(table: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """`row, vec_id, v`: vectors of floor(scale * x), of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    numbers = F.transform(F.col(embedding), lambda x: x.cast("double"))
    kept = table.select(F.col(vec_id).cast("long").alias("vec_id"), numbers.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))


def _vectors(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By dimension: it, the positions, the matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, flat[starts[at][:, None] + np.arange(dim)]


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def fit(sample: np.ndarray, pivots: int, rings: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, each the sample's farthest point from those before, and each pivot's inner ring edges, quantiles of its distances."""
    chosen, near = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    points = sample[chosen]
    far = _distances(sample, points)
    nearest = far.argmin(1)
    share = np.arange(1, rings) / rings
    edges = np.stack([np.quantile(d if len(d := far[nearest == k, k]) else far[:, k], share) for k in range(len(points))])
    return points, edges


class Index:
    """What every task needs of the index, all of bounded size: by dimension the pivots, ring edges and sample; by ring its range, largest norm and blocks."""

    def __init__(self, sample_ids: np.ndarray, sample: list[np.ndarray], pivots: int, rings: int):
        self.sample, self.model, self.rings = {}, {}, {}
        for dim in {len(v) for v in sample}:
            at = [i for i, v in enumerate(sample) if len(v) == dim]
            self.sample[dim] = sample_ids[at], np.stack([sample[i] for i in at])
            self.model[dim] = fit(self.sample[dim][1], pivots, rings)

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return self.model.get(dim) or (np.zeros((1, dim)), np.zeros((1, 0)))

    def place(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, edges = self.of(dim)
        far = _distances(x, points)
        pivot = far.argmin(1)
        d = far[np.arange(len(x)), pivot]
        return pivot, (edges[pivot] <= d[:, None]).sum(1), d

    def bounds(self, dim: int, q: np.ndarray) -> np.ndarray:
        """The most that each query's product with a row of each ring can be."""
        ring = self.rings[dim]
        d = _distances(q, self.of(dim)[0])[:, ring["pivot"]]
        gap = np.maximum(0, np.maximum(d - ring["outer"], ring["inner"] - d) - 1e-6 * (1 + d))
        norm = np.sqrt((q * q).sum(1))[:, None]
        by_gap = (norm**2 + ring["norm"] ** 2 - gap**2) / 2
        by_pivot = q @ self.of(dim)[0].T[:, ring["pivot"]] + norm * ring["outer"]
        return np.minimum(np.minimum(by_gap, by_pivot), norm * ring["norm"]) * (1 + 1e-9) + 1e-3


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _placed(vectors: DataFrame, shared) -> DataFrame:
    """`vec_id, row, dim, pivot, ring, distance, norm, data` of every vector; `data` is its doubles' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for dim, at, x in _vectors(batch.column(2)):
                pivot, ring, d = index.place(dim, x)
                data = pa.array([v.tobytes() for v in x], pa.binary())
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(0).take(take), pa.array(np.full(len(at), dim)), pa.array(pivot), pa.array(ring), pa.array(d), pa.array(np.sqrt((x * x).sum(1))), data], names=["vec_id", "row", "dim", "pivot", "ring", "distance", "norm", "data"])

    return vectors.mapInArrow(run, "vec_id long, row long, dim long, pivot long, ring long, distance double, norm double, data binary")


def _seeds(queries: DataFrame, shared, k: int) -> DataFrame:
    """`row, vec_id, dim, data, least`: each query with its k-th best score in the sample, or minus infinity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for dim, at, q in _vectors(batch.column(2)):
                least = np.full(len(at), -np.inf)
                if dim in index.sample and len(index.sample[dim][0]) > k:
                    known, x = index.sample[dim]
                    for start in range(0, len(at), QUERY_BLOCK):
                        part = slice(start, start + QUERY_BLOCK)
                        scores = np.where(known[None] == ids[at[part], None], -np.inf, q[part] @ x.T)
                        least[part] = np.partition(scores, -k, axis=1)[:, -k]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(at), dim)), pa.array([v.tobytes() for v in q], pa.binary()), pa.array(least)], names=["row", "vec_id", "dim", "data", "least"])

    return queries.mapInArrow(run, "row long, vec_id long, dim long, data binary, least double")


def _sent(queries: DataFrame, shared, first: bool, first_rings: int) -> DataFrame:
    """Blocks of queries `dim, pivot, ring, queries, ids, rows, least` for the rings they must see: the first few by bound, or all others that reach their k-th best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                where = np.flatnonzero(dims == dim)
                if int(dim) not in index.rings:
                    continue
                for start in range(0, len(where), QUERY_BLOCK):
                    at = where[start : start + QUERY_BLOCK]
                    q = np.frombuffer(b"".join(batch.column(3).take(pa.array(at)).to_pylist())).reshape(-1, int(dim))
                    least = batch.column(4).to_numpy()[at]
                    bound = index.bounds(int(dim), q)
                    place = (-bound).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                    due = (place < first_rings if first else place >= first_rings) & (bound >= least[:, None])
                    ring, rows = index.rings[int(dim)], []
                    for r in np.flatnonzero(due.any(axis=0)):
                        m = due[:, r]
                        own = pa.array(at[m])
                        rows.append((int(dim), int(ring["pivot"][r]), int(ring["ring"][r]), q[m].tobytes(), batch.column(1).take(own).to_numpy().tobytes(), batch.column(0).take(own).to_numpy().tobytes(), least[m].tobytes()))
                    yield _batch(rows, ["dim", "pivot", "ring", "queries", "ids", "rows", "least"], [pa.int64()] * 3 + [pa.binary()] * 4)

    return queries.select("row", "vec_id", "dim", "data", "least").mapInArrow(run, "dim long, pivot long, ring long, queries binary, ids binary, rows binary, least binary")


def _blocks(placed: DataFrame, rings: DataFrame) -> DataFrame:
    """The index's rows in blocks: `dim, pivot, ring, block_ids, block`."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        data = b"".join(table.column("data").to_pylist())
        key = [table.column(c).slice(0, 1).combine_chunks() for c in ("dim", "pivot", "ring")]
        return pa.table([*key, pa.array([ids.tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["dim", "pivot", "ring", "block_ids", "block"])

    part = F.pmod(F.xxhash64("vec_id", "row"), F.col("parts"))
    keyed = placed.join(rings, ["dim", "pivot", "ring"]).withColumn("part", part).select("dim", "pivot", "ring", "part", "vec_id", "data")
    return keyed.groupBy("dim", "pivot", "ring", "part").applyInArrow(pack, "dim long, pivot long, ring long, block_ids binary, block binary")


def _met(sent: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """`row, query_id, vec_id, score`: of each query block with each row block, each query's k best that reach its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, queries, ids, rows, least, block_ids, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, x = np.frombuffer(queries).reshape(-1, dim), np.frombuffer(block).reshape(-1, dim)
                own, known = np.frombuffer(ids, np.int64), np.frombuffer(block_ids, np.int64)
                order = known.argsort(kind="stable")
                scores = q @ x[order].T
                scores[(known[order][None] == own[:, None]) | (scores < np.frombuffer(least)[:, None])] = -np.inf
                best = (-scores).argsort(axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(scores, best, axis=1)
                i, j = np.nonzero(value > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rows, np.int64)[i]), pa.array(own[i]), pa.array(known[order][best[i, j]]), pa.array(value[i, j].astype(np.int64))], names=["row", "query_id", "vec_id", "score"])

    both = sent.hint("merge").join(blocks, ["dim", "pivot", "ring"]).select("dim", "queries", "ids", "rows", "least", "block_ids", "block")
    return both.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    by_score = W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, query_filter, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256, sample: int = SAMPLE, pivots: int = PIVOTS, rings: int = RINGS, first_rings: int = FIRST_RINGS) -> DataFrame:
    """`query_id, rank, vec_id, score` of the rows for which the column `query_filter` (over `vec_id`) holds, against all others."""
    vectors = written(whole_vectors(table, vec_id, embedding, scale), "search-vectors")
    drawn = written(vectors.orderBy(F.xxhash64("vec_id"), "row").limit(sample), "search-sample").toPandas()  # at most `sample` vectors
    index = Index(drawn.vec_id.to_numpy(), [np.asarray(v) for v in drawn.v], pivots, rings)
    context = table.sparkSession.sparkContext
    shared = context.broadcast(index)
    placed = written(_placed(vectors, shared), "search-placed")
    stats = placed.groupBy("dim", "pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.max("norm").alias("norm"))
    stats = written(stats, "search-rings")
    known = stats.orderBy("dim", "pivot", "ring").toPandas()  # at most pivots * rings of a dimension
    for dim, own in known.groupby("dim"):
        index.rings[int(dim)] = {c: own[c].to_numpy() for c in ("pivot", "ring", "inner", "outer", "norm")}
    shared = context.broadcast(index)
    size = min(MOST_BLOCK, max(LEAST_BLOCK, int(known.n.sum()) // 2048))
    blocks = written(_blocks(placed, stats.select("dim", "pivot", "ring", F.ceil(F.col("n") / size).alias("parts"))), "search-blocks")
    queries = written(_seeds(vectors.filter(query_filter), shared, k), "search-queries")
    first = written(_best(_met(_sent(queries, shared, True, first_rings), blocks, k), k).drop("rank"), "search-first")
    found = first.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    raised = queries.join(found, "row", "left").withColumn("least", F.greatest("least", F.coalesce(F.col("kth").cast("double"), F.col("least"))))
    rest = _met(_sent(raised, shared, False, first_rings), blocks, k)
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def op3_pivot_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
