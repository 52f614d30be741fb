"""Operator 13: near copies by SimHash, found with a Gray-order hierarchical index.

A fingerprint's bit is 1 if more than half of a text's shingle hashes have it.
Fingerprints link where at most three bits differ.

1. Texts of one fingerprint become one code. Codes are sorted by Gray rank, in
   which neighbours differ in few bits, and cut into blocks of neighbours.
2. A node stands for sixteen nodes of the level below, the lowest for a block. It
   has the bits that all its codes share, as a mask and a pattern; each level adds
   to a pair of nodes only what its parents didn't share yet, so a pair's
   differences accumulate on the way down, and it goes, with all codes below it,
   as soon as they are more than three.
3. Pairs of nodes are walked from the root, level by level, as tables. What is
   left are pairs of blocks, whose codes meet in a task; there the same index
   goes on below the block, over its runs of 64 and 8 codes, down to codes.
4. Of the links of a pair of blocks a spanning forest is handed on. It connects
   the same codes, and a group of near copies isn't written as all its pairs.
5. Components are those of all forests.

Nothing is broadcast but what Spark finds small; a block has BLOCK codes, so a
task holds two blocks at a time however many copies a text has.

Defined cases: a null or empty text, or one without words, has the fingerprint
zero and links like any other; texts of fewer than three words are one shingle;
texts of any length are read whole. Repeated rows (also of one doc_id) each get
their row; a null doc_id counts as larger than all, and a component of such rows
alone has a null id. An empty table gives an empty one; other columns of the
input aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import forget, table, written
from bookflow.llm.components import components
from bookflow.llm.positions import placed

WORDS, SEED, BITS_APART = 3, 42, 3
#: Codes of a block, nodes of a node, and codes of the nodes below a block.
BLOCK_BITS, FAN_BITS, BELOW = 10, 4, (64, 8, 1)
#: Codes for each range of the sort, about; hashes whose bits are counted at a time.
RANGE, COUNTED = 1 << 14, 1 << 16
_LAST = (1 << 63) - 1


def shingle_hashes(raw: bytes, n: int = WORDS) -> np.ndarray:
    """XXH64 of each run of `n` words of UTF-8 bytes, A-Z lower-cased, joined by single spaces; of all words if they are fewer."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed number."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        count += np.unpackbits(hashes[at : at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """`doc_id, code` of each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(shingle_hashes(cell.as_py() or b"", n)) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["doc_id", "code"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """The number whose Gray code is `code`, shifted so that signed order is that of unsigned ranks."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-1 << 63))


def _node(number: Column) -> list[Column]:
    """The bits that are set in all codes of a node, and those that are set in any."""
    return [number.alias("node"), F.col("every"), F.col("any")]


def _bits(every: str, some: str) -> tuple[Column, Column]:
    """The mask of a node's shared bits, and their pattern."""
    return F.bitwise_not(F.col(every).bitwiseXOR(F.col(some))), F.col(every)


def _met(pairs: DataFrame, nodes: DataFrame, side: str, limit: int) -> DataFrame:
    """Pairs `x, y` of node numbers with the bits of both sides, the bits that both share, `mask`, and how many of these differ, `apart`; `side` has just been expanded, and its new bits are added."""
    found = pairs.drop(f"every_{side}", f"any_{side}").join(nodes.select(F.col("node").alias(side), F.col("every").alias(f"every_{side}"), F.col("any").alias(f"any_{side}")), side)
    (mask_x, pattern_x), (mask_y, pattern_y) = _bits("every_x", "any_x"), _bits("every_y", "any_y")
    both = mask_x.bitwiseAND(mask_y)
    new = both.bitwiseAND(F.bitwise_not(F.col("mask")))
    more = F.bit_count(pattern_x.bitwiseXOR(pattern_y).bitwiseAND(new))
    return found.withColumn("apart", F.col("apart") + more).withColumn("mask", both).filter(F.col("apart") <= limit)


def block_pairs(blocks: DataFrame, limit: int) -> DataFrame:
    """Pairs `x, y` of blocks (`node, every, any`; dense numbers from 0) with x <= y, but for those that differ in more than `limit` bits which each shares; written."""
    levels = [blocks.select("node", "every", "any")]
    sizes = [blocks.count()]
    while sizes[-1] > 1 << FAN_BITS:
        up = levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.bit_and("every").alias("every"), F.bit_or("any").alias("any"))
        levels.append(written(up, "index-nodes"))
        sizes.append(-(-sizes[-1] >> FAN_BITS))
    none = F.lit(0).cast("long")
    top = levels[-1].select(F.col("node").alias("x"), F.explode(F.sequence("node", F.lit(max(sizes[-1] - 1, 0)).cast("long"))).alias("y"))  # sixteen nodes at most
    bare = top.select("x", "y", none.alias("mask"), none.cast("int").alias("apart"), *(F.lit(v).cast("long").alias(f"{c}_{s}") for s in "xy" for c, v in (("every", 0), ("any", -1))))
    pairs = written(_met(_met(bare, levels[-1], "x", limit), levels[-1], "y", limit), "index-pairs")
    for level in reversed(range(len(levels) - 1)):
        below, last = levels[level], F.lit(sizes[level] - 1).cast("long")
        children = lambda c: F.explode(F.sequence(F.shiftleft(c, FAN_BITS), F.least(F.shiftleft(c, FAN_BITS) + ((1 << FAN_BITS) - 1), last)))
        wider = _met(pairs.withColumn("x", children("x")), below, "x", limit)
        wider = _met(wider.withColumn("y", children("y")).filter("x <= y"), below, "y", limit)
        after = written(wider, "index-pairs")
        forget(pairs)
        pairs = after
    forget(*levels[1:])
    return pairs.select("x", "y")


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Masks and patterns of the nodes below a block, down to codes."""
    out = []
    for size in BELOW:
        at = np.arange(0, len(codes), size)
        every, some = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
        out.append((~(every ^ some), every))
    return out


def near_codes(x: np.ndarray, y: np.ndarray, limit: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places in both blocks of codes (unsigned) that differ in at most `limit` bits; of one block with itself, each pair once."""
    i, j, apart = (np.zeros(1, np.int64) for _ in range(3))
    shared = np.zeros(1, np.uint64)
    above = 1 << BLOCK_BITS
    for size, (mask_x, pattern_x), (mask_y, pattern_y) in zip(BELOW, _levels(x), _levels(y), strict=True):
        fan = above // size
        a, b = np.divmod(np.arange(fan * fan), fan)
        parent = np.repeat(np.arange(len(i)), fan * fan)
        i, j = (i[:, None] * fan + a).ravel(), (j[:, None] * fan + b).ravel()
        there = (i < len(mask_x)) & (j < len(mask_y))
        if same:
            there &= i <= j if size > 1 else i < j
        i, j, parent = i[there], j[there], parent[there]
        both = mask_x[i] & mask_y[j]
        apart = apart[parent] + np.bitwise_count((pattern_x[i] ^ pattern_y[j]) & both & ~shared[parent])
        near = apart <= limit
        i, j, apart, shared, above = i[near], j[near], apart[near], both[near], size
    return i, j


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links `a, b` connect: each node but a group's least, and that least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def code_links(codes: DataFrame, limit: int = BITS_APART) -> DataFrame:
    """From written `code, pos` (places in Gray order) to links `x, y` of places, which connect all codes that differ in at most `limit` bits."""
    each = codes.groupBy(F.shiftright("pos", BLOCK_BITS).alias("node")).agg(
        F.bit_and("code").alias("every"), F.bit_or("code").alias("any"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("held")
    )  # BLOCK codes at most
    blocks = written(each.select("node", "every", "any", F.col("held.code").alias("codes")), "index-blocks")
    pairs = block_pairs(blocks, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, own, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                i, j = near_codes(own.values.to_numpy().view(np.uint64), other.values.to_numpy().view(np.uint64), limit, x == y)
                if len(i):
                    found.append(forest(i + (x << BLOCK_BITS), j + (y << BLOCK_BITS)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["x", "y"])

    side = lambda c: blocks.select(F.col("node").alias(c), F.col("codes").alias(f"codes_{c}"))
    met = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "codes_x", "codes_y")
    out = written(met.mapInArrow(run, "x long, y long"), "index-links")
    forget(blocks)
    return out


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, limit: int = BITS_APART) -> DataFrame:
    """`doc_id, fingerprint, component_id` of each row of `docs`."""
    base = written(fingerprints(docs, doc_id, text, n).withColumn("id", F.coalesce("doc_id", F.lit(_LAST))), "simhash-codes")
    distinct = written(base.groupBy("code").agg(F.min("id").alias("id")).withColumn("rank", gray_rank(F.col("code"))), "simhash-distinct")
    codes = placed(distinct, "rank", parts=max(1, distinct.count() // RANGE))
    labels = components(code_links(codes.select("code", "pos"), limit))
    of_code = codes.join(labels.select(F.col("node").alias("pos"), "label"), "pos", "left").select("code", "id", F.coalesce("label", "pos").alias("label"))
    of_code = written(of_code, "simhash-labels")
    least = of_code.groupBy("label").agg(F.min("id").alias("component"))
    named = written(of_code.join(least, "label").select("code", "component"), "simhash-components")
    forget(distinct, codes, of_code)
    component = F.when(F.col("component") != _LAST, F.col("component"))
    return base.join(named, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
