"""A training-data pipeline over `documents`: five of the operators, one after the other.

Each stage takes all rows that the one before kept, and returns the columns of
documents; the last returns what encoding says of each row of the mix.

Defined cases, of all stages: an empty table gives an empty one; columns besides
`doc_id, text, lang, source` may hold nulls, have any name and are carried to
the last stage but one. A null or empty text, or one without letters, goes in the
first stage. A null doc_id counts as the largest; a null lang teaches nothing; a
null source is a source. Repeated rows are copies, of which one stays. Of equal
choices the least doc_id and then the least hash of the row wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm import language_id, mixing, ngram_join, pii, sentencepiece_lattice
from bookflow.llm.common import small_batches, table, written

#: Near copies: n-grams of five words, Jaccard similarity of 80 % or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Words and units with codes; fewer than alone, as five stages share the workers' memory.
HOT_WORDS, HOT_UNITS = 60_000, 80_000


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without text or letters, and those whose calibrated score is below a half. Without any label all stay. A row with a null text goes; repeated rows go or stay together."""
    small_batches(spark)
    return language_id.accepted(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least doc_id stays, of rows that share it the one of the least hash. Texts without words are linked with nothing and all stay."""
    return ngram_join.one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to its kind. A null text stays null; overlapping spans are replaced as one."""
    return _measured(pii.redact(docs, pii.train(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice; the end of a shard's last block cuts one document. A null text or source is one of no words or a source of its own; ties among rows go by hash, so reruns agree."""
    return _measured(mixing.copies(mixing.mix(docs, keep=docs.columns)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row of the mix its ids in order, how many they are, whether they decode to its text, and their digest. A null or empty text has no ids and is complete."""
    return sentencepiece_lattice.count_encoded(docs, hot_limit=HOT_WORDS, unit_limit=HOT_UNITS)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language ID", tell_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", hide_personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Model fitting, loopy message passing and components aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
