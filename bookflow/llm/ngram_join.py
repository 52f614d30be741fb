"""Operator 2: Jaccard join of documents on word n-grams, by a blocked sparse product.

The matrix is documents by n-grams; a pair's overlap is its entry in the product
with the transpose:

1. Documents with equal sets become one row of the matrix.
2. The columns get one global order, the rarest first: n-grams are counted in a
   fixed number of hashed counters, summed over all documents. Counters that
   n-grams share only make the order coarser; it moves work and never the result.
3. Two linked rows share one of their leading columns, as many as their sizes
   ask for; rows meet there, within a size band.
4. A row has a number of blocks of columns in proportion to its size, and keeps
   its count in each. The lesser counts of both rows, summed, bound a pair's
   overlap; pairs go that stay below the overlap that their two sizes ask for.
5. The product of the rows that are left is taken in blocks of columns. A pair's
   overlap adds up block by block, and the pair is dropped as soon as what it
   has, with the most that the blocks to come can add, is below the bound.

A group of near copies would meet in all pairs. So rows first meet, for each of
their columns and bands, its hub alone: the row whose leading columns are the
most frequent, which stands in the middle of its copies. A row's overlap is
taken with the hubs that it shares most columns with. These links make
components, and then only rows of different components meet; of each column's
main component no two rows are paired. All links between components are found
that way, and copies within one are never expanded.

Defined cases: a null or blank text is empty, linked with nothing; texts under n
words are one n-gram; a null doc_id is larger than all and is reported as null
where it is alone; repeated rows fall together; rows that share a doc_id are
separate; an empty table gives an empty one; other columns aren't carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from bookflow.llm.common import forget, table, written
from bookflow.llm.components import components
from bookflow.llm.wordhash import runs, word_hashes

WORDS, PERCENT = 3, 90
#: 2^22 counters of n-grams, kept and summed in 2^8 parts; their levels take one byte each.
COUNTER_BITS, PART_BITS = 22, 8
#: Levels are eighths of a power of two.
LEVELS = 8
#: Hubs whose overlap a row takes in full.
HUBS = 2
#: Blocks of the product; and n-grams in a counted block, about, and most blocks of a row.
BLOCKS, BLOCK_GRAMS, MOST_BLOCKS = 16, 4, 1 << 14
_LAST = (1 << 63) - 1


def shingles(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text's UTF-8 bytes, A-Z lower-cased."""
    one = word_hashes((raw or b"").lower())
    return np.unique(runs(one, n) if len(one) >= n else runs(one, len(one), 1) if len(one) else one)


def _ragged(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    key = F.col(doc_id).cast("long")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(_LAST)).alias("id"), F.xxhash64(F.col(text)).alias("content"), F.col(text).cast("binary").alias("text"))


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams & np.uint64((1 << bits) - 1)).astype(np.int64)


def _matrix(keyed: DataFrame, n: int, bits: int) -> DataFrame:
    """`row, doc_id, id, content, n_shingles, key` of each document, and for each task the parts of its counters, with null `row`."""
    names = ["row", "doc_id", "id", "content", "n_shingles", "key", "part", "counts"]
    width = 1 << (bits - min(bits, PART_BITS))

    def parts(counters: np.ndarray) -> Iterator[pa.RecordBatch]:
        lines, pack = counters.reshape(-1, width), ZstdCompressor(level=1).compress
        for at in range(0, len(lines), 32):
            some = lines[at : at + 32]
            nothing = [pa.nulls(len(some), pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*nothing, pa.nulls(len(some), pa.binary()), pa.array(np.arange(at, at + len(some))), pa.array([pack(x.tobytes()) for x in some], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, waiting = np.zeros(1 << bits, np.uint32), []

        def count() -> None:
            np.add(counters, np.bincount(_bucket(np.concatenate(waiting), bits), minlength=1 << bits).astype(np.uint32), out=counters)
            waiting.clear()

        for batch in batches:
            sets = [shingles(cell.as_py(), n) for cell in batch.column(4)]
            keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([*map(len, sets)], pa.int64()), pa.array(keys, pa.binary()), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names=names)
            waiting += sets
            if sum(map(len, waiting)) >= 1 << 20:
                count()
        if waiting:
            count()
        if counters.any():
            yield from parts(counters)

    rows = keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "id", "content", "text")
    return rows.mapInArrow(run, "row long, doc_id long, id long, content long, n_shingles long, key binary, part long, counts binary")


def _levels(counted: DataFrame, bits: int) -> np.ndarray:
    """The level of each counter, of the sums over all tasks. Tasks sum the parts that come to them one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = ZstdDecompressor().decompress
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(unpack(counts.as_py()), np.uint32).astype(np.int64)
                sums[part] = own + sums[part] if part in sums else own
        levels = [np.floor(np.log2(x + 1.0) * LEVELS).clip(0, 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(levels, pa.binary())], names=["part", "levels"])

    summed = counted.repartition("part").mapInArrow(run, "part long, levels binary").collect()  # 2^bits bytes in all
    out = np.zeros(1 << bits, np.uint8)
    width = 1 << (bits - min(bits, PART_BITS))
    for r in summed:
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.levels, np.uint8)
    return out


def block_counts(grams: np.ndarray) -> bytes:
    """How many of a row's n-grams fall into each of its blocks of columns, 255 for that and more. The blocks are a power of two, by the leading bits of the hashes."""
    bits = max(6, min(MOST_BLOCKS, max(1, len(grams) // BLOCK_GRAMS)).bit_length())
    return np.minimum(np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def could_reach(x: bytes, y: bytes, need: int) -> bool:
    """Whether rows of these block counts can have an overlap of `need`. The finer counts are added up to the coarser blocks."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    full = (a == 255).any() and (b == 255).any()
    width = min(len(a), len(b))
    least = np.minimum(a.reshape(width, -1).sum(axis=1, dtype=np.int64), b.reshape(width, -1).sum(axis=1, dtype=np.int64)).sum()
    return bool(full or least >= need)


def _leading(keyed: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """`id, content, key, n_shingles, leading, weight, blocks`: the first columns of each row in the global order, by level and hash, the sum of their levels, and the counts in the row's blocks."""
    shared = keyed.sparkSession.sparkContext.broadcast(levels)
    bits = int(len(levels)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        for batch in batches:
            keys, sizes, lead, weights, blocks = [], [], [], [], []
            for cell in batch.column(2):
                s = shingles(cell.as_py(), n)
                size = len(s)
                level = level_of[_bucket(s, bits)]
                first = np.argsort(level, kind="stable")[: size - -(-percent * size // 100) + 1 if size else 0]
                keys.append(hashlib.md5(s.tobytes()).digest())
                sizes.append(size)
                lead.append(s[first])
                weights.append(int(level[first].sum(dtype=np.int64)))
                blocks.append(block_counts(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), _ragged(lead), pa.array(weights, pa.int64()), pa.array(blocks, pa.binary())], names=["id", "content", "key", "n_shingles", "leading", "weight", "blocks"])

    return keyed.select("id", "content", "text").mapInArrow(run, "id long, content long, key binary, n_shingles long, leading array<long>, weight long, blocks binary")


def reaching(x: list[np.ndarray], y: list[np.ndarray], percent: int, blocks: int = BLOCKS) -> np.ndarray:
    """Which pairs of sorted sets of hashes have an overlap that reaches `percent` of their union: the overlaps add up by blocks of columns, and pairs go as soon as the blocks to come can't make up."""
    count = len(x)
    pair = np.repeat(np.tile(np.arange(count), 2), [*map(len, x), *map(len, y)])
    gram = np.concatenate([*x, *y]) if count else np.zeros(0, np.uint64)
    block = ((gram >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    half = sum(map(len, x))
    sizes = [np.bincount(pair[part] * blocks + block[part], minlength=count * blocks).reshape(count, blocks) for part in (slice(half), slice(half, None))]
    to_come = np.minimum(*sizes)[:, ::-1].cumsum(axis=1)[:, ::-1]
    have, total = np.zeros(count, np.int64), sizes[0].sum(axis=1) + sizes[1].sum(axis=1)
    alive = np.ones(count, bool)
    by_block = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[by_block], np.arange(blocks + 1))
    for k in range(blocks):
        alive &= (100 + percent) * (have + to_come[:, k]) >= percent * total
        own = by_block[ends[k] : ends[k + 1]]
        own = own[alive[pair[own]]]
        p, g = pair[own], gram[own]
        order = np.lexsort((g, p))
        p, g = p[order], g[order]
        have += np.bincount(p[1:][(p[1:] == p[:-1]) & (g[1:] == g[:-1])], minlength=count)
    return alive & ((100 + percent) * have >= percent * total) & (total > 0)


def _could(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those pairs `x, y` whose block counts can reach the overlap that their sizes ask for, written."""
    side = lambda c: rows.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("blocks").alias(f"b{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = -(-percent * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // (100 + percent))
            keep = [could_reach(a.as_py(), b.as_py(), n) for a, b, n in zip(batch.column(4), batch.column(5), need.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "nx", "ny", "bx", "by")
    return written(both.mapInArrow(run, "x long, y long"), "join-pairs")


def _linked(pairs: DataFrame, rows: DataFrame, keyed: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs `x, y` of a written table whose overlap reaches the bound, written. Sets are made for the rows of these pairs alone."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _ragged([shingles(t.as_py(), n) for t in batch.column(1)])], names=["node", "grams"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([values[a:b] for a, b in zip(ends, ends[1:], strict=False)] for c in (2, 3) for ends, values in [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy().view(np.uint64))])
            yield batch.select([0, 1]).filter(pa.array(reaching(x, y, percent), pa.bool_()))

    named = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct().join(rows.select("node", "id", "content"), "node")
    texts = keyed.select("id", "content", "text").join(named, ["id", "content"]).select("node", "text")
    sets = written(texts.dropDuplicates(["node"]).mapInArrow(sets_of, "node long, grams array<long>"), "join-sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}"))
    both = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "gx", "gy")
    out = written(both.mapInArrow(met, "x long, y long"), "join-links")
    forget(sets, pairs)
    return out


def _to_hubs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs `x, y` of each row and the hubs that it shares most columns with."""
    hub = F.max(F.struct("weight", "node", "n_shingles")).alias("hub")
    hubs = entries.groupBy("gram", "band").agg(hub, F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "band", F.col("hub.node").alias("y"), F.col("hub.n_shingles").alias("ny"))
    alike = 100 * F.least("n_shingles", "ny") >= percent * F.greatest("n_shingles", "ny")
    met = entries.join(hubs, ["gram", "band"]).filter((F.col("node") != F.col("y")) & alike).groupBy(F.col("node").alias("x"), "y").count()
    best = met.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("count", (-F.col("y")).alias("last"))), asc=False).alias("best"))
    pairs = best.select("x", F.explode(F.slice("best", 1, HUBS)).alias("of")).select("x", (-F.col("of.last")).alias("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _across(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs `x, y` of rows of different components that share a leading column, and whose columns from there on can reach the overlap."""
    placed = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = placed.groupBy("gram", "label").count().groupBy("gram").agg(F.max(F.struct("count", "label")).alias("most"), F.count(F.lit(1)).alias("n"))
    placed = placed.join(labelled.filter("n > 1").select("gram", F.col("most.label").alias("main")), "gram")
    left = placed.filter("label != main").select("gram", F.col("node").alias("x"), F.col("n_shingles").alias("nx"), F.col("pos").alias("px"), F.col("label").alias("lx"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = placed.select("gram", "band", F.col("node").alias("y"), F.col("n_shingles").alias("ny"), F.col("pos").alias("py"), F.col("label").alias("ly"))
    reach = (100 + percent) * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= percent * (F.col("nx") + F.col("ny"))
    alike = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    pairs = left.join(right, ["gram", "band"]).filter((F.col("lx") != F.col("ly")) & alike & reach)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT, counter_bits: int = COUNTER_BITS) -> DataFrame:
    """`row, doc_id, content, n_shingles, component_id, is_first` for each row of `docs`.

    `content` is xxhash64 of the text; `is_first` marks one row of each
    component, of its least doc_id.
    """
    keyed = _keyed(docs, doc_id, text)
    matrix = written(_matrix(keyed, n, counter_bits), "join-matrix")
    base = matrix.filter(F.col("row").isNotNull()).drop("part", "counts")
    firsts = written(base.filter("n_shingles > 0").groupBy("key").agg(F.min(F.struct("id", "row")).alias("first")).select("key", F.col("first.id").alias("first_id"), F.col("first.row").alias("node")), "join-firsts")
    levels = _levels(matrix.filter(F.col("row").isNull()).select("part", "counts"), counter_bits)

    lead = _leading(keyed, n, percent, levels).filter("n_shingles > 0").join(firsts, "key").filter("id = first_id")
    rows = written(lead.dropDuplicates(["node"]).select("node", "id", "content", "n_shingles", "weight", "leading", "blocks"), "join-rows")
    band = F.floor(F.log(F.col("n_shingles")) / math.log(100 / percent)).cast("int")
    entries = rows.select("node", F.col("n_shingles").cast("int").alias("n_shingles"), F.col("weight").cast("int").alias("weight"), band.alias("band"), F.posexplode("leading").alias("pos", "gram"))
    meet = entries.groupBy("gram").count().filter("count > 1").select("gram")
    entries = written(entries.join(meet, "gram"), "join-entries")

    links = _linked(_could(_to_hubs(entries, percent), rows, percent), rows, keyed, n, percent)
    labels = components(links)
    more = _linked(_could(_across(entries, labels, percent), rows, percent), rows, keyed, n, percent)
    all_labels = components(labels.select(F.col("node").alias("x"), F.col("label").alias("y")).union(more))
    forget(entries, links, more)

    placed = written(all_labels.join(rows.select("node", "id"), "node"), "join-labels")
    least = placed.groupBy("label").agg(F.min(F.struct("id", "node")).alias("least"))
    named = placed.join(least, "label").select("node", F.col("least.id").alias("component"), F.col("least.node").alias("leader"))
    nodes = written(firsts.join(named, "node", "left").select("key", "node", F.coalesce("component", "first_id").alias("component"), F.coalesce("leader", "node").alias("leader")), "join-nodes")
    forget(firsts, rows, placed)
    out = base.join(nodes, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(
        "row", "doc_id", "content", "n_shingles",
        F.when(component != _LAST, component).alias("component_id"),
        F.coalesce(F.col("row") == F.col("leader"), F.lit(True)).alias("is_first"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row left of each component: its first, of the least doc_id. Rows without words all stay."""
    found = jaccard_components(docs, doc_id, text, n, percent)
    found = found.withColumn("id", F.coalesce("doc_id", F.lit(_LAST))).groupBy("id", "content").agg(F.sum(F.col("is_first").cast("int")).alias("stay"))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col(text)).alias("content"), F.struct("*").alias("doc"))
    equal = W.partitionBy("id", "content").orderBy(F.xxhash64("doc"))
    kept = rows.join(written(found.filter("stay > 0"), "join-stay"), ["id", "content"])
    return kept.withColumn("place", F.row_number().over(equal)).filter("place <= stay").select("doc.*")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share an n-gram are counted here, and reachability is spelled out.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM texts),
runs AS (SELECT doc_id, n, p, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS g FROM words),
grams AS (SELECT DISTINCT doc_id, g FROM runs WHERE p <= greatest(1, n - 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common c JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c.n >= 90 * (s.n + t.n - c.n)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x),
least AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, t.doc_id) AS component_id
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
