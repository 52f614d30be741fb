"""Batches through a correction model: prompt, call with retries, parse, and back to the blocks.

The model is any function of a request's text; `identity` and `by_table` work
without a network. Results are meant to be written before they are used again,
so a retried task doesn't call twice what is already paid for.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.operators.batching import parse_response
from bookflow.operators.chains import kept, with_checkpoints

Model = Callable[[str], str]


def identity(request: str) -> str:
    return request


def by_table(words: dict[str, str]) -> Model:
    """A model that replaces whole words."""
    pattern = re.compile("|".join(rf"\b{re.escape(w)}\b" for w in sorted(words, key=len, reverse=True))) if words else None
    return lambda request: pattern.sub(lambda m: words[m[0]], request) if pattern else request


def with_retries(model: Model, tries: int = 4, wait: float = 2.0, growth: float = 1.8, longest: float = 15.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """`model`, called again after growing waits while it raises. An error with a number in `retry_after` names its own wait."""

    def call(request: str) -> str:
        delay = wait
        for k in range(tries):
            try:
                return model(request)
            except Exception as error:
                if k == tries - 1:
                    raise
                named = getattr(error, "retry_after", None)
                sleep(delay if named is None else float(named))
                delay = min(delay * growth, longest)
        return ""

    return call


def in_turn(*models: Model) -> Model:
    """The answer of the first of `models` that doesn't raise; the last one's error if all do."""

    def call(request: str) -> str:
        for model in models[:-1]:
            try:
                return model(request)
            except Exception:
                continue
        return models[-1](request)

    return call


def corrected(blocks: DataFrame, batches: DataFrame, model: Model, parallel: int = 2, pause: float = 0.0) -> DataFrame:
    """`book, ord, corrected` of `book, ord, text`, by batches `book, ord, batch`; a block that the response lacks keeps its text.

    `parallel` tasks call at a time, each with `pause` seconds between calls.
    """

    @F.pandas_udf("string")
    def ask(requests: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in requests:
            answers = []
            for request in some:
                answers.append(model(request))
                if pause:
                    time.sleep(pause)
            yield pd.Series(answers, dtype=object)

    listed = _listed(blocks, batches).repartition(parallel)
    answered = listed.select("book", "items", ask.asNondeterministic()(_marked("items")).alias("answer"))
    both = answered.select("book", F.explode(_answered()).alias("x"))
    return both.select("book", F.col("x.items.ord").alias("ord"), _or_own_text().alias("corrected"))


def _listed(blocks: DataFrame, batches: DataFrame) -> DataFrame:
    return blocks.join(batches, ["book", "ord"]).groupBy("book", "batch").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("items"))


def _answered() -> F.Column:
    """The blocks of a batch, `items`, each with its part of the batch's `answer`."""
    return F.arrays_zip("items", parse_response(F.col("answer"), F.size("items")).alias("answer"))


def _or_own_text() -> F.Column:
    return F.coalesce(F.nullif(F.col("x.answer"), F.lit("")), F.col("x.items.text"))


def _marked(items: str) -> F.Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("[BLOCK_"), i.cast("string"), F.lit("]"), x["text"], F.lit("[/BLOCK_"), i.cast("string"), F.lit("]"))), "\n")


def attempted(requests: DataFrame, model: Model) -> DataFrame:
    """`requests` with `answer` and `error` in place of `request`: the one or the other. An error of the model is a row, so it neither ends the job nor takes other answers with it. Only requests go to Python."""

    @F.pandas_udf("answer string, error string")
    def ask(requests: pd.Series) -> pd.DataFrame:
        answers, errors = [], []
        for request in requests:
            try:
                answers.append(model(request))
                errors.append(None)
            except Exception as error:
                answers.append(None)
                errors.append(f"{type(error).__name__}: {error}"[:500])
        return pd.DataFrame({"answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object)})

    return requests.withColumn("_got", ask.asNondeterministic()("request")).select(*[c for c in requests.columns if c != "request"], "_got.*")


def corrected_or_failed(blocks: DataFrame, batches: DataFrame, model: Model, parallel: int = 2) -> DataFrame:
    """`book, ord, corrected, source, error` of `book, ord, text`, by batches `book, ord, batch`: `llm` with the answer, `error` with the text as it was and the model's last error.

    A batch that fails is halved and asked again, until its failing blocks stand
    alone: a batch of n blocks takes log2(n) + 1 rounds at most. Each round's
    answers are written before the next begins, so what has been paid for is
    never asked again, whatever is lost later.
    """
    with_checkpoints(blocks.sparkSession)
    waiting, out = _listed(blocks, batches).select("book", "items"), None
    while True:
        answers = kept(attempted(waiting.repartition(parallel).withColumn("request", _marked("items")), model))
        good = answers.filter("error IS NULL").select("book", F.explode(_answered()).alias("x"))
        done = good.select("book", F.col("x.items.ord").alias("ord"), _or_own_text().alias("corrected"), F.lit("llm").alias("source"), F.lit(None).cast("string").alias("error"))
        bad = answers.filter("error IS NOT NULL")
        alone = bad.filter("size(items) = 1").select("book", F.col("items")[0]["ord"].alias("ord"), F.col("items")[0]["text"].alias("corrected"), F.lit("error").alias("source"), "error")
        out = done.unionByName(alone) if out is None else out.unionByName(done).unionByName(alone)
        half = F.ceil(F.size("items") / 2).cast("int")
        waiting = bad.filter("size(items) > 1").select("book", F.explode(F.array(F.slice("items", F.lit(1), half), F.slice("items", half + 1, F.size("items") - half))).alias("items"))
        if waiting.isEmpty():
            return out


def audit_by_source(changes: DataFrame) -> DataFrame:
    """`source, n` of log rows, and of all of them as `all`, in one pass."""
    return changes.rollup("source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), "n")
