"""Places in a text that look damaged, with what stands around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import LETTERS, WS

# Patterns of the two kinds, and the width of what is shown on either side.
KINDS = {"hyphen split": f"(?<![{LETTERS}])[{LETTERS}]++-{WS}+[{LETTERS}]+", "space before punctuation": f"(?<!{WS}){WS}++[,.!?:;]"}
#: Patterns with as many matches: of what stands before the sign that counts, the last letter or space is enough.
COUNTED = {"hyphen split": f"[{LETTERS}]-{WS}+[{LETTERS}]+", "space before punctuation": f"{WS}[,.!?:;]"}
AROUND, FIRST = 30, 15


def places(blocks: DataFrame, keys: list[str], text: str, kind: str, first: int | None = None) -> DataFrame:
    """`kind, keys, pos, match, snippet` of each match, or of a block's `first`; `pos` from 0. A match begins after all pieces and matches before it."""
    t = F.col(text)
    cut = lambda parts: parts if first is None else F.slice(parts, 1, first)
    found, pieces = cut(F.regexp_extract_all(t, F.lit(f"({KINDS[kind]})"), 1)), cut(F.split(t, KINDS[kind], -1))
    each = blocks.select(*keys, t.alias("_text"), pieces.alias("_pieces"), found.alias("_found")).filter(F.size("_found") > 0)
    length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda total, p: total + F.char_length(p))
    rows = each.select("*", F.posexplode("_found").alias("_nth", "match")).withColumn("pos", length("_pieces", F.col("_nth") + 1) + length("_found", F.col("_nth")))
    begin = F.greatest(F.lit(0), F.col("pos") - AROUND)
    end = F.least(F.char_length("_text"), F.col("pos") + F.char_length("match") + AROUND)
    return rows.select(F.lit(kind).alias("kind"), *keys, "pos", "match", F.substring("_text", begin + 1, end - begin).alias("snippet"))


def first_places(blocks: DataFrame, keys: list[str], text: str, first: int = FIRST) -> DataFrame:
    """The `first` places of each kind in the order of `keys`, and how many there are in all.

    Each of the first blocks with a match has one of its own, so the first places
    are in so many blocks, and only those are cut into pieces; in all others
    matches are counted.
    """
    counts = blocks.agg(*[F.sum(F.regexp_count(text, F.lit(pattern))).alias(kind) for kind, pattern in COUNTED.items()])
    total = counts.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"`{kind}`").alias("n")) for kind in KINDS])))
    tops = []
    for kind in KINDS:
        some = blocks.filter(F.col(text).rlike(COUNTED[kind])).orderBy(*keys, F.regexp_instr(text, F.lit(KINDS[kind]))).limit(first)
        tops.append(places(some, keys, text, kind, first).orderBy(*keys, "pos").limit(first))
    return reduce(DataFrame.unionByName, tops).join(F.broadcast(total), "kind")  # a row for each kind
