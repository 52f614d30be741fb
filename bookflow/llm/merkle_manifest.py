"""Operator 11: a Merkle manifest of a dataset, by message passing over its trees.

A row's leaf is a hash of its fields. The leaves of each source, in order of
doc_id, are hashed in runs of sixteen until one node, the subroot, remains; the
subroots, in order of source, likewise give the root.

Leaves are hashed in the JVM where the texts are read; texts are never shuffled.
Places in order come from ranges and their counts, so that no task sees all
leaves of a source. The trees are graphs of RDD records, one for each run, and
are walked in supersteps:

* up: children send their hash to their parent. A parent that has all of its
  children hashes them and forwards its own hash; one that lacks some keeps what
  it has for the next superstep (the tree of subroots waits for its tallest
  source). It ends when nothing is sent and nothing waits.
* down: parents send to each child the runs between it and the root. What
  arrives at the lowest runs gives each of their leaves its siblings: they are
  hashed to the proof, and the leaf, altered where it was tampered with, is
  folded up through them.

A parent has sixteen children at most, so no vertex is hot, and the number of
supersteps is the height of the trees. Each superstep is written to the shared
folder, which cuts the lineage: a lost executor costs one of them at most.

Defined cases: a null field is `-` in its leaf, and a null source is a source of
its own, the first; a null doc_id comes after all others of its source and is
never tampered with; rows that share a doc_id are ordered by their leaf; repeated
rows are leaves of their own; fields may be empty or of any length; an empty
table gives an empty one. Other columns of the input neither count nor clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.llm.common import forget, scratch_dir, table, written
from bookflow.llm.positions import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; one doc_id of so many is tampered with; records of a task at least.
RUN, TAMPERED, TASK = 16, 5, 2_000
_TOP = ""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: A run of nodes: its tree (a source's key, or _TOP), the level above its nodes, and its number there.
Vertex = tuple[str, int, int]


class Up(NamedTuple):
    """From a child to its parent: its place in the run, the number of nodes on its level, the place of its tree among `trees`, its hash; of a vertex its name and the superstep that completed it, of a leaf its doc_id and its altered hash."""

    place: int
    level_size: int
    tree: int
    trees: int
    digest: bytes
    child: Vertex | None
    step: int
    doc_id: int | None
    altered: bytes | None


class Run(NamedTuple):
    """A completed vertex."""

    vertex: Vertex
    children: list[Up]
    digest: bytes


class Down(NamedTuple):
    """To a vertex: for each run from its own hash to the root the place in it and its hashes, one after the other; the subroot, where known, and the root."""

    path: list[tuple[int, bytes]]
    subroot: bytes | None
    root: bytes


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """`doc_id, key, leaf, altered` of each row: `key` is a text in the order of sources, `altered` the leaf of a row that is tampered with."""
    digest = lambda text: F.unhex(F.sha2(F.concat(*(_field(F.col(f"own.{f}")) for f in FIELDS[:-1]), _field(text)).cast("binary"), 256))
    text, doc_id = F.col("own.text"), F.col("own.doc_id").cast("long")
    hit = doc_id.isNotNull() & (F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0)
    source = F.col("own.source").cast("string")
    return docs.select(F.struct(*FIELDS).alias("own")).select(
        doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
        digest(text).alias("leaf"), F.when(hit, digest(F.translate(text, _UPPER, _LOWER))).alias("altered"),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """`leaves` with each one's place in its source, the size of the source, the place of the source and the number of sources; written."""
    leaf_table = written(leaves(docs).withColumn("last", F.col("doc_id").isNull()), "merkle-leaves")
    at = placed(leaf_table, "key", "last", "doc_id", "leaf")
    here = at.groupBy("key", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each source and range
    spread = W.partitionBy("key")
    here = here.withColumn("size", F.sum("n").over(spread)).withColumn("first", F.min("first").over(spread))
    sources = placed(at.select("key").distinct(), "key").select("key", F.col("pos").alias("tree"))
    trees = sources.count()
    known = here.join(sources, "key").select("key", "part", "first", "size", "tree")
    out = at.join(known, ["key", "part"]).select("key", (F.col("pos") - F.col("first")).alias("place"), "size", "tree", F.lit(trees).cast("long").alias("trees"), "doc_id", "leaf", "altered")
    out = written(out, "merkle-numbered")
    forget(leaf_table, at)
    return out


def _hash(digests: bytes) -> bytes:
    """The hash of digests that stand one after the other, as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def _dealt(vertex: Vertex) -> int:
    return zlib.crc32(repr(vertex).encode())


class _Tables:
    """Supersteps in the shared folder."""

    def __init__(self, spark) -> None:
        self.spark, self.context = spark, spark.sparkContext
        self.path = f"{scratch_dir(spark)}/merkle-{uuid.uuid4().hex}"

    def save(self, records: RDD, name: str, most: int) -> RDD:
        """`records`, `most` at most, written and read back in tasks of TASK records, however many files they are in."""
        records.saveAsPickleFile(f"{self.path}/{name}")
        return self.context.pickleFile(f"{self.path}/{name}").coalesce(self.parts(most))

    def parts(self, records: int) -> int:
        return max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-records // TASK)))


def _gathered(vertex: Vertex, messages: list[Up], step: int) -> tuple[int, Run] | tuple[None, tuple[Vertex, list[Up]]]:
    """The completed vertex with its superstep, or what waits."""
    size = messages[0].level_size
    if len(messages) < min(RUN, size - RUN * vertex[2]):
        return None, (vertex, messages)
    messages.sort()
    joined = b"".join(m.digest for m in messages)
    return step, Run(vertex, messages, joined if size == 1 else _hash(joined))  # a lone node is what remains


def _onward(told: tuple, step: int) -> Iterator[tuple[Vertex, Up]]:
    """The message of a completed vertex to its parent, or those that wait."""
    if told[0] is None:
        vertex, messages = told[1]
        yield from ((vertex, m) for m in messages)
        return
    run = told[1]
    (tree, level, number), first = run.vertex, run.children[0]
    size = -(-first.level_size // RUN)
    if size > 1:
        yield (tree, level + 1, number // RUN), Up(number % RUN, size, first.tree, first.trees, run.digest, run.vertex, step, None, None)
    elif tree != _TOP:
        yield (_TOP, 1, first.tree // RUN), Up(first.tree % RUN, first.trees, 0, 1, run.digest, run.vertex, step, None, None)


def _to_children(run: Run, down: Down) -> Iterator[tuple[int, tuple[Vertex, Down]]]:
    """The messages to the vertices below, each with the superstep in which it was completed."""
    joined = b"".join(c.digest for c in run.children)
    for place, child in enumerate(run.children):
        path = down.path if child.level_size == 1 else [(place, joined), *down.path]
        yield child.step, (child.child, Down(path, child.digest if run.vertex[0] == _TOP and child.child[0] != _TOP else down.subroot, down.root))


def _others(place: int, joined: bytes) -> str:
    return (joined[: 32 * place] + joined[32 * place + 32 :]).hex()


def verified(run: Run, down: Down) -> Iterator[tuple]:
    """The rows of a lowest run's leaves."""
    joined = b"".join(c.digest for c in run.children)
    above = "".join(_others(*p) for p in down.path)
    for place, leaf in enumerate(run.children):
        own = [] if leaf.level_size == 1 else [(place, joined)]
        proof = "".join(_others(*p) for p in own) + above
        node = leaf.altered or leaf.digest
        for at, hashes in [*own, *down.path]:
            node = _hash(hashes[: 32 * at] + node + hashes[32 * at + 32 :])
        yield leaf.doc_id, leaf.digest.hex(), down.subroot.hex(), down.root.hex(), hashlib.sha256(proof.encode()).hexdigest(), node.hex(), node == down.root


def manifest(docs: DataFrame) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root, verified` of each row of `docs`, which has the columns FIELDS."""
    spark = docs.sparkSession
    tables, rows = _Tables(spark), numbered(docs)
    count = rows.count()
    start = lambda r: ((r[0], 1, r[1] // RUN), Up(r[1] % RUN, r[2], r[3], r[4], bytes(r[6]), None, 0, r[5], bytes(r[7]) if r[7] else None))
    sent = rows.rdd.map(start)
    steps: list[RDD] = []
    sizes: list[int] = []
    while count:
        step = len(steps)
        groups = sent.groupByKey(tables.parts(count), _dealt)
        told = tables.save(groups.map(lambda kv, step=step: _gathered(kv[0], list(kv[1]), step)), f"up-{step}", count)
        steps.append(told.filter(lambda x: x[0] is not None).values())
        sizes.append(count)
        sent = told.flatMap(lambda x, step=step: _onward(x, step))
        if step == 0:
            forget(rows)
        count = sent.count()
    if not steps:
        return spark.createDataFrame([], _RESULT)

    is_root = lambda run: run.vertex[0] == _TOP and run.children[0].level_size <= RUN
    last = len(steps) - 1
    pending = steps[last].filter(is_root).map(lambda run: (last, (run.vertex, Down([], None, run.digest))))
    out = None
    for step in reversed(range(len(steps))):
        here = pending.filter(lambda x, step=step: x[0] == step).values()
        met = steps[step].map(lambda run: (run.vertex, run)).cogroup(here, tables.parts(sizes[step]))
        both = met.flatMap(lambda kv: [(run, down) for run in kv[1][0] for down in kv[1][1]])
        if step == 0:
            out = both.flatMap(lambda x: verified(*x))  # the lowest runs are those of the first superstep
        else:
            later = pending.filter(lambda x, step=step: x[0] < step)
            pending = tables.save(both.flatMap(lambda x: _to_children(*x)).union(later), f"down-{step}", sizes[step])
    return spark.createDataFrame(out, _RESULT, verifySchema=False)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: Trees grow level by level in the first recursion; the second walks from each leaf up, with its siblings and its altered hash.
ORACLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, coalesce(xor(crc, 4294967295) % 5 = 0, false) AS hit,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS altered
  FROM fields),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, h) - 1 AS pos, count(*) OVER (PARTITION BY key) AS size, dense_rank() OVER (ORDER BY key) - 1 AS tree FROM leaf),
up AS (
  SELECT key, 0 AS level, pos, size, h FROM numbered
  UNION ALL
  SELECT key, level + 1, pos // 16, (any_value(size) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE size > 1 GROUP BY key, level, pos // 16),
top AS (
  SELECT '' AS key, 0 AS level, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS size, h FROM up WHERE size = 1
  UNION ALL
  SELECT key, level + 1, pos // 16, (any_value(size) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY key, level, pos // 16),
nodes AS (
  SELECT key, level, pos, size, coalesce(string_agg(h, '') OVER before, '') AS l, coalesce(string_agg(h, '') OVER after, '') AS r FROM (FROM up UNION ALL FROM top)
  WINDOW before AS (PARTITION BY key, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY key, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walk AS (
  SELECT row_number() OVER () AS id, doc_id, h AS leaf, key AS source, tree, key, 0 AS level, pos, CASE WHEN hit THEN altered ELSE h END AS h, '' AS proof, false AS done FROM numbered
  UNION ALL
  SELECT id, doc_id, leaf, source, tree, CASE WHEN size > 1 THEN w.key ELSE '' END, CASE WHEN size > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN size > 1 THEN w.pos // 16 ELSE tree END,
    CASE WHEN size > 1 THEN sha256(l || h || r) ELSE h END, CASE WHEN size > 1 THEN proof || l || r ELSE proof END, size = 1 AND w.key = ''
  FROM walk w JOIN nodes n ON n.key = w.key AND n.level = w.level AND n.pos = w.pos WHERE NOT done)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM walk w JOIN up s ON s.key = w.source AND s.size = 1 CROSS JOIN (SELECT h FROM top WHERE size = 1) t WHERE done
"""
