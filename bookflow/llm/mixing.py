"""Operator 5: mix sources to target weights by Sainte-Laguë apportionment.

The mix is a number of equal-token blocks. They go to the sources, and within
a source to its shards, by the highest quotients `weight / (2k - 1)`, so every
source and every shard gets a whole number of blocks. A shard's documents stand
in a seeded order and form one stream of words that is read round and round;
its quota takes that many leading blocks. A document's `taken` is the part of
those blocks that covers it.

Everything is DataFrame functions: no Python runs on the executors. Quotas
beyond the rounded share are found among the few seats near it, so neither the
number of seats nor of blocks is ever materialised. A source is split into
shards of about `shard_rows` rows, so a hot source is many window partitions.

Defined cases: a null text has size 0; a document of size 0 takes nothing; a
null source is a source of its own, last in order; a null doc_id is ordered as
an empty one; repeated rows are separate documents; an empty table gives an
empty mix; columns of the input named as this module's own are left alone,
because the input row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.llm.common import WORD, table, word_count, written

#: Weights of the sources in order of code points, repeating; share of all words in the mix; most uses of a document.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BLOCK_TOKENS, SHARD_ROWS, SEED = 64, 1024, 5


def targets(sizes: DataFrame) -> DataFrame:
    """From rows of `source, source_size, source_rows` also `pos, weight, target`.

    A target is `weight * level`, cut at CAP times the source's size. Sorted by
    the level at which each is cut, the cut ones are a prefix, so one pass finds
    the level that repeated resharing ends at. Whole numbers decide who is cut.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("pos") % len(WEIGHTS) + 1).cast("int"))
    numbered = sizes.withColumn("pos", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", weight.cast("long"))
    by_cut = W.orderBy(F.col("source_size") / F.col("weight"), "pos")
    all_rows = W.partitionBy()
    scaled = (
        numbered.withColumn("twice_mix", (F.lit(2 * SHARE) * F.sum("source_size").over(all_rows)).cast("long"))
        .withColumn("cut_before", F.sum(F.col("source_size") * CAP).over(by_cut) - F.col("source_size") * CAP)
        .withColumn("weight_left", F.sum("weight").over(all_rows) - F.sum("weight").over(by_cut) + F.col("weight"))
        .withColumn("room", F.col("twice_mix") - 2 * F.col("cut_before"))
        .withColumn("is_cut", 2 * CAP * F.col("source_size") * F.col("weight_left") < F.col("weight") * F.col("room"))
    )
    level = F.max(F.when(~F.col("is_cut"), F.col("room") / (2 * F.col("weight_left")))).over(all_rows)
    target = F.when(F.col("is_cut"), (F.col("source_size") * CAP).cast("double")).otherwise(F.col("weight") * level)
    return scaled.withColumn("target", target).select("source", "source_size", "source_rows", "pos", "weight", "target", "twice_mix")


def apportion(rows: DataFrame, group: list[str], weight: str, seats: str, tie: str, into: str) -> DataFrame:
    """Adds column `into`: the row's seats out of its group's `seats`, by Sainte-Laguë.

    The group's seats are the highest quotients weight / (2k - 1), ties by `tie`.
    With n rows, rounding each exact share is off by at most n / 2 seats in all,
    and a row's part in mending that is at most its share of 1.5 n, and one. Only
    that many quotients about each rounded share are listed, at most 5 n in all.
    """
    part = W.partitionBy(*group)
    total, n = F.sum(weight).over(part), F.count(F.lit(1)).over(part)
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    near = (
        rows.withColumn("_total", total).withColumn("_n", n)
        .withColumn("_round", F.floor(share * F.col(seats) + 0.5).cast("long"))
        .withColumn("_reach", (F.ceil(share * F.col("_n") * 1.5) + 1).cast("long"))
        .withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.col("_round") - F.col("_reach")))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(part))
    )
    listed = near.filter(F.col(weight) > 0).withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, F.col("_round") + F.col("_reach"))))
    highest = W.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_seat") - 1)).desc(), tie, "_seat")
    won = listed.withColumn("_rank", F.row_number().over(highest)).filter(F.col("_rank") <= F.col("_open"))
    counts = won.groupBy(*group, tie).agg(F.count(F.lit(1)).alias("_won"))
    keys = list(dict.fromkeys([*group, tie]))
    out = near.join(counts, keys, "left")
    return out.withColumn(into, F.when(F.col(weight) > 0, F.col("_sure") + F.coalesce("_won", F.lit(0))).otherwise(0).cast("long")).select(*rows.columns, into)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text", keep: list[str] | None = None, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """One row for each row of `docs`: `row` (the columns `keep` as a struct), `doc_id, source, size, source_size, target, taken`.

    Documents stand in a shard by a seeded hash of doc_id, ties by size and row.
    """
    size = word_count(F.col(text)) if size is None else size
    key = F.md5(F.concat_ws(":", F.lit(f"mix{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    plain = docs.select(F.struct(*[F.col(c) for c in keep or [doc_id]]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    sizes = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")), "mix-sizes")
    per_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    quotas = apportion(per_source.withColumn("blocks", F.floor(F.col("twice_mix") / (2 * block_tokens)).cast("long")).withColumn("whole", F.lit(0)), ["whole"], "target", "blocks", "pos", "quota")
    quotas = written(quotas.withColumn("shards", F.ceil(F.col("source_rows") / shard_rows).cast("long")).select("source", "pos", "source_size", "target", "quota", "shards"), "mix-sources")

    def sharded(rows: DataFrame) -> DataFrame:
        number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
        named = quotas.withColumnRenamed("source", "its")
        return rows.withColumn("key", key).join(named, F.col("source").eqNullSafe(F.col("its"))).withColumn("shard", number % F.col("shards")).drop("its")

    shards = sharded(sizes).groupBy("pos", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = written(apportion(shards, ["pos"], "shard_size", "quota", "shard", "shard_quota").select("pos", "shard", "shard_size", "shard_quota"), "mix-shards")
    stream = W.partitionBy("pos", "shard").orderBy("key", "doc_id", "size", F.xxhash64("row")).rowsBetween(W.unboundedPreceding, W.currentRow)
    words = F.least(F.col("shard_quota") * block_tokens, CAP * F.col("shard_size"))
    rounds = F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0)
    return (
        sharded(plain).withColumn("ends", F.sum("size").over(stream))
        .join(shards, ["pos", "shard"]).withColumn("words", words).withColumn("rounds", rounds)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("rounds") * F.col("shard_size") - F.col("ends") + F.col("size"))))
        .withColumn("taken", (F.col("rounds") * F.col("size") + F.col("part")).cast("long"))
        .select("row", "doc_id", "source", "size", "source_size", "target", "taken")
    )


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, from `mix(keep=all columns)`: each document as often as it is taken whole, and cut to its leading words where a block ends inside it."""
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    each = mixed.withColumn("_whole", whole.cast("int")).withColumn("_rest", rest)
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_whole")))).filter((F.col("_copy") < F.col("_whole")) | (F.col("_rest") > 0))
    cut = F.when(F.col("_copy") < F.col("_whole"), F.col(f"row.{text}")).otherwise(F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text}"), F.lit(f"({WORD})"), 1), F.lit(1), F.col("_rest").cast("int")), " "))
    return each.withColumn("row", F.col("row").withField(text, cut)).select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: All quotients are listed and ranked here, for the sources and for the shards.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix5:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sizes GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(pos % 3 + 1)::INT]::BIGINT AS weight, (3 * sum(source_size) OVER ())::BIGINT AS twice_mix FROM sources),
cuts AS (
  SELECT *, (twice_mix - 2 * (sum(2 * source_size) OVER c - 2 * source_size))::BIGINT AS room,
         (sum(weight) OVER () - sum(weight) OVER c + weight)::BIGINT AS weight_left
  FROM weighed WINDOW c AS (ORDER BY source_size / weight, pos)),
levels AS (SELECT *, 4 * source_size * weight_left < weight * room AS is_cut FROM cuts),
targets AS (
  SELECT *, CASE WHEN is_cut THEN (2 * source_size)::DOUBLE
    ELSE weight * max(CASE WHEN NOT is_cut THEN room / (2 * weight_left) END) OVER () END AS target FROM levels),
seats AS (
  SELECT pos, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, pos, k) AS place, twice_mix // 128 AS blocks
  FROM (SELECT *, unnest(range(1, (twice_mix // 128 + 2)::BIGINT)) AS k FROM targets WHERE target > 0)),
quotas AS (
  SELECT t.*, coalesce(q.quota, 0) AS quota, ceil(source_rows / 1024)::BIGINT AS shards
  FROM targets t LEFT JOIN (SELECT pos, count(*) AS quota FROM seats WHERE place <= blocks GROUP BY pos) q USING (pos)),
dealt AS (
  SELECT s.*, q.pos, q.source_size, q.target, q.quota, ('0x' || substr(key, 1, 8))::BIGINT % q.shards AS shard
  FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT pos, shard, quota, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL),
shard_seats AS (
  SELECT pos, shard, quota, row_number() OVER (PARTITION BY pos ORDER BY shard_size / (2 * k - 1) DESC, shard, k) AS place
  FROM (SELECT *, unnest(range(1, quota + 1)) AS k FROM shards WHERE shard_size > 0)),
shard_quotas AS (
  SELECT s.*, least(64 * coalesce(q.n, 0), 2 * shard_size)::BIGINT AS words
  FROM shards s LEFT JOIN (SELECT pos, shard, count(*) AS n FROM shard_seats WHERE place <= quota GROUP BY ALL) q USING (pos, shard)),
streams AS (
  SELECT *, sum(size) OVER (PARTITION BY pos, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begins FROM dealt)
SELECT doc_id, size, source_size, target,
  (CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(0, least(size, words % shard_size - begins)) ELSE 0 END)::BIGINT AS taken
FROM streams JOIN shard_quotas USING (pos, shard)
"""
