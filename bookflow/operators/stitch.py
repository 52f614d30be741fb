"""Joining text that a page or line break cut: islands over ordered blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import LETTERS, LOWER, WS, trimmed


def is_noise(text) -> F.Column:
    """A paragraph of one or two signs, or of a single letter with a quote at most."""
    return (F.char_length(text) <= 2) & text.rlike(f"^[^{LETTERS}0-9]+\\z") | text.rlike(f"^[{LETTERS}]{WS}*[\"']?\\z")


def stitch_paragraphs(blocks: DataFrame, book: str, order: str, text: str, is_heading: F.Column) -> DataFrame:
    """Paragraphs joined across breaks: `book, first, last, pieces, text, is_heading`.

    A normal paragraph goes on from the last normal one if that ends with a
    hyphen, or without closing punctuation where this one starts in lower case.
    The end of a joined text is the end of its last piece, so each pair of
    neighbours decides alone and a running sum numbers the islands.
    """
    rows = blocks.select(F.col(book).alias("book"), F.col(order).alias("ord"), trimmed(F.col(text)).alias("t"), is_heading.alias("is_heading"))
    rows = rows.filter((F.col("t") != "") & ~is_noise(F.col("t")))
    in_order = W.partitionBy("book").orderBy("ord")
    normal = rows.filter(~F.col("is_heading")).withColumn("before", F.lag("t").over(in_order))
    hyphen = F.col("before").endswith("-")
    open_end = ~F.col("before").rlike(f"[.?!:»\"']{WS}*\\z") & F.col("t").rlike(f"^[{LOWER}]")
    joins = F.coalesce(hyphen | open_end, F.lit(False))
    marked = normal.withColumn("joins", joins).withColumn("hyphen", F.coalesce(hyphen, F.lit(False))).withColumn("next_hyphen", F.coalesce(F.lead("joins").over(in_order) & F.col("t").endswith("-"), F.lit(False))).withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(in_order))
    piece = F.concat(F.when(F.col("joins") & ~F.col("hyphen"), " ").otherwise(""), F.when(F.col("next_hyphen"), F.expr("left(t, char_length(t) - 1)")).otherwise(F.col("t")))
    parts = F.sort_array(F.collect_list(F.struct("ord", "piece")))
    merged = marked.withColumn("piece", piece).groupBy("book", "island").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("pieces"), F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))
    headings = rows.filter("is_heading").select("book", F.col("ord").alias("first"), F.col("ord").alias("last"), F.lit(1).cast("long").alias("pieces"), F.col("t").alias("text"), F.lit(True).alias("is_heading"))
    return merged.select("book", "first", "last", "pieces", "text", F.lit(False).alias("is_heading")).unionByName(headings)


def merge_hyphen_pairs(blocks: DataFrame, book: str, order: str, text: str) -> DataFrame:
    """`book, ord, text, is_merged`: a block that ends in a letter and a hyphen takes the next one where that starts in lower case.

    A block that was taken can't take another, so in a run of candidates every
    other one does, from the first.
    """
    in_order = W.partitionBy("book").orderBy("ord")
    rows = blocks.select(F.col(book).alias("book"), F.col(order).alias("ord"), trimmed(F.col(text)).alias("t")).withColumn("after", F.lead("t").over(in_order))
    can = F.coalesce(F.col("t").rlike(f"[{LETTERS}0-9]-\\z") & F.col("after").rlike(f"^[{LOWER}]"), F.lit(False))
    rows = rows.withColumn("can", can).withColumn("starts", F.when(F.col("can") & ~F.coalesce(F.lag("can").over(in_order), F.lit(False)), 1).otherwise(0)).withColumn("run", F.sum("starts").over(in_order))
    in_run = W.partitionBy("book", "run", "can").orderBy("ord")
    rows = rows.withColumn("takes", F.col("can") & (F.row_number().over(in_run) % 2 == 1)).withColumn("is_merged", F.coalesce(F.lag("takes").over(in_order), F.lit(False)))
    joined = F.when(F.col("takes"), F.concat(F.expr("left(t, char_length(t) - 1)"), F.col("after"))).when(F.col("is_merged"), "").otherwise(F.col("t"))
    return rows.select("book", "ord", joined.alias("text"), "is_merged")
