"""Substring removal and the Jaccard join against brute force, over odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from bookflow.llm import ngram_join, substring_dedup, wordhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def removed_by_hand(rows, length):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (i, k):
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def linked_by_hand(rows, n, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = {}
    for k, (_, s) in enumerate(sets):
        for j, common in Counter(j for g in s for j in held.get(g, ())).items():
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                parent[top(k)] = top(j)
        for g in s:
            held.setdefault(g, []).append(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


def odd_rows():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)] + ["É", "ß", "日本"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(40)]
    rows = list(base)
    for text in base[:6]:
        for _ in range(25):
            w = text.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
            rows.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows += [f"{rng.choice(words)} {passage} {' '.join(rng.choice(words) for _ in range(20))}" for _ in range(30)]
    rows += [None, "", "  \t\n", "one", "ONE", "one two", "One\ttwo", "same " * 90, "same " * 15, base[0], base[0], "  nbsp word", " ".join(words * 30)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in odd_rows()], "doc_id long, text string, id string, row int").repartition(5)


def test_substring_dedup(frame):
    got = sorted(map(tuple, substring_dedup.dedup(frame).collect()))
    assert got == removed_by_hand(odd_rows(), 20)
    assert sorted(map(tuple, substring_dedup.dedup(frame, window=6).collect())) == removed_by_hand(odd_rows(), 6)


def test_substring_dedup_repeated_and_empty(spark):
    text = " ".join(f"a{k}" for k in range(25))
    rows = spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(rows).collect()), key=str)
    assert got == sorted([(3, 25, 0), (5, 25, 25), (5, 25, 25), (None, 25, 25), (None, 0, 0)], key=str)
    assert substring_dedup.dedup(rows.limit(0)).collect() == []


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_components(frame, n, percent):
    got = ngram_join.jaccard_components(frame, n=n, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == linked_by_hand(odd_rows(), n, percent)


def test_jaccard_order_is_only_an_order(frame):
    few = ngram_join.jaccard_components(frame, counter_bits=3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in few.collect()) == linked_by_hand(odd_rows(), 3, 90)


def near_group(copies: int):
    """Copies of one text with up to ten words changed: many are linked with few others, some with none; and texts of five times their length."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = []
    for k in range(copies):
        words = list(base)
        for _ in range(rng.randrange(11)):
            words[rng.randrange(200)] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(words)))
    return rows + [(copies + k, " ".join(rng.choice(base) for _ in range(1000))) for k in range(3)] + [(copies + 5, " ".join(base * 5)), (copies + 6, " ".join(base * 6))]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_large_group_of_near_copies(spark, n, percent):
    rows = near_group(2000)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_by_hand(rows, n, percent)


def test_block_products_equal_whole_overlaps():
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(0, 1 << 64, 300, np.uint64)) for _ in range(50)] + [np.zeros(0, np.uint64)]
    y = [np.unique(np.concatenate([s[rng.random(len(s)) < share], rng.integers(0, 1 << 64, 20, np.uint64)])) for s, share in zip(x, np.linspace(0.7, 1, len(x)), strict=True)]
    for blocks in (1, 16, 64):
        got = ngram_join.reaching(x, y, 80, blocks)
        assert got.tolist() == [100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for a, b in zip(x, y, strict=True)]
        assert 0 < got.sum() < len(x)
    for a, b in zip(x, y, strict=True):
        overlap = len(np.intersect1d(a, b))
        assert ngram_join.could_reach(ngram_join.block_counts(a), ngram_join.block_counts(b), overlap)
        assert not ngram_join.could_reach(ngram_join.block_counts(a), ngram_join.block_counts(b), min(len(a), len(b)) + 1)
    assert ngram_join.could_reach(ngram_join.block_counts(x[0]), ngram_join.block_counts(np.concatenate([*x, *y])), len(x[0]))
    assert not ngram_join.could_reach(ngram_join.block_counts(x[0]), ngram_join.block_counts(x[1]), 280)
    assert ngram_join.reaching([], [], 80).tolist() == [] and ngram_join.reaching([x[-1]], [x[-1]], 80).tolist() == [False]


def test_one_of_each_keeps_columns_and_first_rows(spark):
    text = " ".join(f"a{k}" for k in range(25))
    rows = spark.createDataFrame([(5, text, 1), (5, text, 1), (3, text.upper(), 2), (7, "other words here", 3), (8, None, 4), (8, None, 4), (9, "", 5)], "doc_id long, text string, key int")
    got = sorted((r.doc_id, r.key) for r in ngram_join.one_of_each(rows).collect())
    assert got == [(3, 2), (7, 3), (8, 4), (8, 4), (9, 5)]
    assert ngram_join.jaccard_components(rows.limit(0)).collect() == []


def test_word_hashes_follow_the_words():
    for raw in (b"", b" \n", b"a", b" ab  c\x0bd\x0c", ("x" * 300 + " é").encode(), b"a\x00b c"):
        assert len(wordhash.word_hashes(raw)) == len(raw.split())
    assert wordhash.word_hashes(b"ab cd ab")[0] == wordhash.word_hashes(b"\tab")[0] != wordhash.word_hashes(b"ba")[0]
    one = wordhash.word_hashes(b"a b c d e f")
    assert (wordhash.runs(one, 3)[1] == wordhash.runs(one[1:4], 3)[0]).all() and len(wordhash.runs(one, 7)) == 0
