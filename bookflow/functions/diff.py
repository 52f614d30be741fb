"""Word-level differences: the shortest edit between two texts cut into words, white space and single signs."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s+|\w+|[^\w\s]")


def _less(a: list[str], b: list[str], kind: str) -> list[tuple[str, str]] | None:
    """The steps where `a` is `b` with more tokens in it, of `kind`; None where it isn't. The shortest path then takes each token of `b` as soon as it comes."""
    steps, at, n = [], 0, len(b)
    for k, token in enumerate(a):
        if at < n and b[at] == token:
            steps.append(("equal", token))
            at += 1
        elif len(a) - k > n - at:
            steps.append((kind, token))
        else:
            return None
    return steps


def edits(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Kind and text of maximal runs that are equal, removed or added, by the greedy shortest-path method; removals stand before additions. Linear where one text only has more tokens than the other."""
    steps = _less(a, b, "removed") if len(a) >= len(b) else _less(b, a, "added")
    return _runs(_steps(a, b) if steps is None else steps)


def _runs(steps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(kind, "".join(t for _, t in run)) for kind, run in groupby(steps, itemgetter(0))]


def _steps(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Each token as equal, removed or added."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    head, a, b = a[:start], a[start:], b[start:]
    reach, trail = {1: 0}, []
    for depth in range(len(a) + len(b) + 1):
        trail.append(array("i", (reach.get(k, 0) for k in range(-depth - 1, depth + 2))))
        for k in range(-depth, depth + 1, 2):
            down = k == -depth or k != depth and reach[k - 1] < reach[k + 1]
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    x, y, steps = len(a), len(b), []
    for depth in range(len(trail) - 1, -1, -1):
        before, k = trail[depth], x - y
        at = k + depth + 1
        down = k == -depth or k != depth and before[at - 1] < before[at + 1]
        last = k + 1 if down else k - 1
        px = before[at + 1 if down else at - 1] if depth else 0
        py = px - last if depth else 0
        while x > px and y > py and (x, y) != (0, 0) and a[x - 1] == b[y - 1]:
            steps.append(("equal", a[x - 1]))
            x, y = x - 1, y - 1
        if depth:
            steps.append(("added", b[y - 1]) if down else ("removed", a[x - 1]))
            x, y = px, py
    return [("equal", t) for t in head] + steps[::-1]


def text_diff(a: str | None, b: str | None) -> tuple[list[tuple[str, str]], int]:
    """The runs, and the number of words in what was added."""
    found = edits(_TOKEN.findall(a or ""), _TOKEN.findall(b or ""))
    return found, sum(len(t.split()) for kind, t in found if kind == "added")


def _batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        rows = [text_diff(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        kinds, values = [k for d, _ in rows for k, _ in d], [v for d, _ in rows for _, v in d]
        runs = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["type", "value"])
        ends = pa.array(list(accumulate((len(d) for d, _ in rows), initial=0)), pa.int32())
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, runs), pa.array([n for _, n in rows], pa.int32())], ["diffs", "fixed_words"])


def diff_column(original: Column, corrected: Column) -> Column:
    """`diffs` and `fixed_words` of two texts. Python sees no equal ones: they are one run."""
    kind = "struct<diffs:array<struct<type:string,value:string>>,fixed_words:int>"
    udf = F.arrow_udf(_batches, kind)
    a, b = F.coalesce(original, F.lit("")), F.coalesce(corrected, F.lit(""))
    whole = F.when(a != "", F.array(F.struct(F.lit("equal").alias("type"), a.alias("value")))).otherwise(F.array())
    return F.when(a == b, F.struct(whole.alias("diffs"), F.lit(0).alias("fixed_words")).cast(kind)).otherwise(udf(F.when(a != b, a), F.when(a != b, b)))
