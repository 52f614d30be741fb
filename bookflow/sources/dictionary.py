"""Word lists: loading one, and building one from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import LETTERS, LOWER, trimmed, turkish_lower
from bookflow.operators.chains import kept, with_checkpoints


def load(spark: SparkSession, path: str) -> DataFrame:
    """`word`: the lines of a text file, trimmed, without blank and repeated ones."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("word")).filter("word <> ''").distinct()


def build(texts: DataFrame, text: str, least: int = 2) -> DataFrame:
    """`word`: the distinct words of texts, in Turkish lower case with the circumflex folded. Order by `word collate tr` where a sorted file is wanted."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}âîûÂÎÛ]+)"), 1)).alias("w")).filter(F.char_length("w") >= least)
    return words.select(F.translate(turkish_lower(F.col("w")), "âîû", "aiu").alias("word")).distinct()


def known(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """`key, words, known`: how many different words a text has, and how many of them the list knows.

    Texts are dealt out by `key` before they become words, which stay where their
    text is unless the list is too large to be broadcast: written first, it has a
    size by which Spark decides that.
    """
    with_checkpoints(texts.sparkSession)
    listed = kept(words.select("word").distinct()).withColumn("listed", F.lit(1))
    low = F.lower(F.translate(F.col(text), "İI\u212aâîûÂÎÛ", "iı aiuaiu"))  # the Kelvin sign is no letter here, though a k in lower case
    dealt = texts.select(key, F.col(text)).repartition(key)
    each = dealt.select(key, F.explode(F.regexp_extract_all(low, F.lit(f"([{LOWER}]+)"), 1)).alias("word")).filter(F.char_length("word") >= 2).distinct()
    return each.join(listed, "word", "left").groupBy(key).agg(F.count(F.lit(1)).alias("words"), F.count("listed").alias("known"))


def in_order(words: DataFrame) -> DataFrame:
    """`word, letter, place`: the words by Turkish collation (c ç, ı i, o ö, s ş, u ü), each with its place among those of its first letter.

    A letter's words are one window, and the list as a whole is never in one task.
    """
    letter = F.substring("word", 1, 1)
    place = F.row_number().over(W.partitionBy("letter").orderBy(F.collate("word", "tr"), "word"))
    return words.withColumn("letter", letter).withColumn("place", place).select("word", "letter", "place")
