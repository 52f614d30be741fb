"""Operator 10: token counts from distinct pre-tokens.

A pre-token here is a run of text from one lone space to before the next: the
tokenizer's own pattern always breaks there, and no piece crosses such a break.
Pieces are counted once for each distinct pre-token; the counts are joined to
each document's pre-token frequencies and summed. No document's ids exist at
any time.

The vocabulary grows with the corpus and a few pre-tokens are in every document,
so the join is split by frequency. A first pass finds the most frequent ones, at
most `hot_limit` of at most `hot_chars` characters: this bounded table is
broadcast. The rest, which are rare by construction, go through a shuffled join
on the pre-token. Which ones are hot changes the route and never the result.

Defined cases: a null text is an empty one of 0 tokens; a text of any length is
taken whole; special strings inside a text count as the library counts them;
repeated rows (also of one doc_id) each get their own row; an empty table gives
an empty one; other columns of the input aren't carried.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import often_seen, table, written

#: Most pre-tokens that are broadcast, their longest length, and in how many documents of a group one must be to be proposed.
HOT_LIMIT, HOT_CHARS, HOT_DOCS = 200_000, 32, 2
TOKEN_LIMIT = 1024
#: A space beside another white-space character: there the cheap cut isn't safe.
_BESIDE = re.compile(r" \s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_counts(texts: list[str], path: str) -> list[int]:
    return [len(e.ids) for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def pre_tokens(text: str) -> Counter:
    """How often each pre-token is in `text`; joined in order they are the text."""
    cuts = _SAFE.split(text) if _BESIDE.search(text) else text.split(" ")
    first = cuts.pop(0)
    found = Counter(cuts)
    found = Counter({" " + k: n for k, n in found.items()})
    if first:
        found[first] += 1
    return found


def frequent(docs: DataFrame, text: str, limit: int, chars: int, least: int) -> DataFrame:
    """`piece`: at most `limit` pre-tokens of the most documents, proposed by groups in which `least` documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return often_seen(batches, lambda value: [k for k in pre_tokens(value) if len(k) <= chars], least)

    counted = docs.select(text).mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.col("n").desc(), "item").limit(limit).select(F.col("item").alias("piece"))


def counted(pieces: DataFrame, path: str) -> DataFrame:
    """`piece, tokens` of distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.column(0).slice(at, 20_000)
                yield pa.RecordBatch.from_arrays([part, pa.array(piece_counts(part.to_pylist(), path), pa.int64())], names=["piece", "tokens"])

    return pieces.mapInArrow(run, "piece string, tokens long")


def frequencies(docs: DataFrame, doc_id: str, text: str, hot: dict[str, int]) -> DataFrame:
    """A row for each document: `row, doc_id, n_bytes`, the tokens of its hot pre-tokens, and the frequencies of the others."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    rest = pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            sums, pieces, times, ends = [], [], [], [0]
            for cell in batch.column(3):
                total = 0
                for piece, n in pre_tokens(cell.as_py() or "").items():
                    tokens = known(piece)
                    if tokens is None:
                        pieces.append(piece)
                        times.append(n)
                    else:
                        total += tokens * n
                sums.append(total)
                ends.append(len(pieces))
            items = pa.StructArray.from_arrays([pa.array(pieces, pa.string()), pa.array(times, pa.int64())], fields=list(rest.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64()), lists], names=["row", "doc_id", "n_bytes", "hot_tokens", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_bytes long, hot_tokens long, rest array<struct<piece:string,times:long>>")


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, token_limit: int = TOKEN_LIMIT, hot_limit: int = HOT_LIMIT, hot_chars: int = HOT_CHARS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` for each row of `docs`."""
    path = path or default_tokenizer()
    hot = counted(frequent(docs, text, hot_limit, hot_chars, hot_docs), path).toArrow()  # at most hot_limit short rows
    per_doc = written(frequencies(docs, doc_id, text, dict(zip(hot["piece"].to_pylist(), hot["tokens"].to_pylist(), strict=True))), "tokens-by-doc")
    pairs = per_doc.select("row", F.explode("rest").alias("item")).select("row", "item.piece", "item.times")
    vocabulary = written(counted(pairs.select("piece").distinct(), path), "tokens-vocabulary")
    rest = pairs.join(vocabulary, "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("rest_tokens"))
    total = F.col("hot_tokens") + F.coalesce("rest_tokens", F.lit(0))
    return per_doc.select("row", "doc_id", "n_bytes", "hot_tokens").join(rest, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > token_limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
