"""Operators 11 to 13 against plain versions over odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bookflow.llm import merkle_manifest, positions, simhash_index, token_alignment
from bookflow.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "x", 7) for i, t, lang, s, n in rows], SCHEMA)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def lower(t):
        return t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def leaf(row, alter):
        i, t, lang, s, n = row
        return h(field(i) + field(s) + field(lang) + field(n) + field(lower(t) if alter else t))

    def tree(nodes):
        """The root, and for each node its way up: pairs of place and run."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
            for w, k in zip(ways, at, strict=True):
                w.append((k % 16, runs[k // 16]))
            at, nodes = [k // 16 for k in at], [h("".join(r)) for r in runs]
        return nodes[0], ways

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is None, r[0] or 0, leaf(r, False))
    by = {s: sorted((r for r in rows if r[3] == s), key=order) for s in sources}
    trees = {s: tree([leaf(r, False) for r in by[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, above, strict=True):
        for row, way in zip(by[s], trees[s][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node, proof = leaf(row, hit), ""
            for k, run in way + top:
                proof += "".join(run[:k] + run[k + 1 :])
                node = h("".join([*run[:k], node, *run[k + 1 :]]))
            out.append((row[0], leaf(row, False), trees[s][0], root, h(proof), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"a": 300, None: 17, "": 1, "é": 16, "z": 2}, {"one": 1}, {"one": 33}, {f"s{k}": 1 for k in range(40)}])
def test_manifest_is_that_of_a_plain_version(spark, sizes):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "", "Plain TEXT é", "x" * 5000, "lower"]), rng.choice([None, "en"]), s, rng.choice([None, 3])) for s, n in sizes.items() for k in range(n)]
    rows += [rows[0], rows[0][:1] + ("Other", None) + rows[0][3:]]
    if len(sizes) > 1:
        rows += [(None, "No id", "en", "a", 1), (None, None, None, None, None)]
    got = sorted((tuple(r) for r in merkle_manifest.manifest(rows_of(spark, rows)).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(rows_of(spark, [])).collect() == []


def test_places_are_dense_and_in_order(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("v"), F.lit(0).alias("at"))
    got = [(r.v, r.pos) for r in positions.placed(df, "v").collect()]
    assert sorted(p for _, p in got) == list(range(1000)) and [v for v, p in sorted(got, key=lambda x: x[1])] == sorted(v for v, _ in got)


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "Line one\n\nline two\t tab \n end", "naïve café 😀 日本語のテキスト 한국어", "<|endoftext|> and </s> <unk> stay text", "a▁b", "x" * 3000, "\x00\x01 control",
    "zorvak blintrop " * 40, "1234567890 12.5%", "ﬁ ligature ① Å", "The cat sat on the mat.", "The cat sat on the mat.", "trailing space ", " non breaking   em",
]


def plain_alignment(texts):
    encode_a, encode_b, bytes_a, bytes_b = token_alignment._loaded(*token_alignment.default_tokenizers())
    found, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (encode_a([" " + text])[0], encode_b([text])[0]) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            found.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((bytes_a, a), (bytes_b, b)))
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a, strict=True) if start < e <= cut], [i for i, e in zip(b, ends_b, strict=True) if start < e <= cut]))
            start = cut
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        counts.update(links.keys())
        found.append((len(a), len(b), groups, links))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for k, f in enumerate(found):
        if f is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((k, a, b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), h(text)))
    return out


@pytest.mark.parametrize(("hot", "pairs"), [(0, 0), (5, 3), (300_000, 1 << 18)])
def test_alignment_is_that_of_whole_texts(spark, hot, pairs):
    docs = rows_of(spark, [(k, t, None, None, None) for k, t in enumerate(TEXTS)]).repartition(3)
    got = token_alignment.alignment_counts(docs, hot_limit=hot, hot_pairs=pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain_alignment(TEXTS)


@pytest.mark.parametrize("most", [0, 1 << 17])
def test_each_shape_is_aligned_once(spark, monkeypatch, most):
    """Stretches whose tokens end alike share one shape; forgotten shapes are met again."""
    monkeypatch.setattr(token_alignment, "SHAPES", most)
    paths = token_alignment.default_tokenizers()
    words = [w for t in TEXTS for w in token_alignment.stretches(t or "")] + [f"zq{a}{b}x" for a in "bcdfghjklm" for b in "bcdfghjklm"]
    words = list(dict.fromkeys(words))
    halves, tokenise, rows = [words[::2], words[1::2], words], token_alignment._tokenizer(*paths), []
    for part in halves:
        place, ints = tokenise(part)
        rows.append([np.argsort(place).tolist(), *(x[0].as_py() for x in ints)])
    shapes, good = [len(r[token_alignment._INTS.index("shape_ends") + 1]) for r in rows], [len(r[1]) for r in rows]
    assert shapes[0] < good[0] and (shapes[2] > 0) == (most == 0)
    bundles = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"bundle long, {token_alignment._SHAPED}").coalesce(1)
    own = {r.bundle: r.own for r in token_alignment.filled(token_alignment.aligned(bundles)).collect()}
    for k, part in enumerate(halves):
        plain = {w: r for w, r in zip(part, plain_alignment([w if w else None for w in part]), strict=True) if w}
        for one in own[k]:
            _, a, b, groups, links, *_, digest = plain.get(part[one.k], (0,) * 8)
            if a:
                assert (one.tokens, one.groups, len(one.links), h(one.written)) == ((a << 32) + b, (groups << 32) + links, links, digest)
            elif part[one.k] in plain:
                assert one.tokens is None and one.links is None


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment_counts(rows_of(spark, [])).collect() == []
    nulls = token_alignment.alignment_counts(rows_of(spark, [(None, None, None, None, None)] * 2)).collect()
    assert [tuple(r) for r in nulls] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_over_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    texts = [r.text for r in docs.collect()]
    got = [tuple(r)[1:] for r in sorted(token_alignment.alignment_counts(docs).collect())]
    assert got == [r[1:] for r in plain_alignment(texts)]


def plain_components(ids, codes, limit=3):
    codes = np.array(codes, np.uint64)
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= limit) + i + 1:
            p, q = find(i), find(int(j))
            label[max(p, q)] = min(p, q)
    return [ids[find(i)] for i in range(len(ids))]


def clustered(rng, clusters, each, flips):
    centres = rng.integers(0, 1 << 63, clusters, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, clusters, dtype=np.uint64)
    out = []
    for c in centres.tolist():
        for _ in range(each):
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False).tolist():
                c ^= 1 << b
            out.append(c)
    return out


@pytest.mark.parametrize(("clusters", "each", "flips"), [(3000, 1, 0), (40, 60, 3), (1, 2500, 2), (300, 8, 5)])
def test_index_connects_what_brute_force_connects(spark, clusters, each, flips):
    codes = sorted(set(clustered(np.random.default_rng(clusters), clusters, each, flips)))
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(c,) for c in signed], "code long").withColumn("rank", simhash_index.gray_rank(F.col("code")))
    placed = positions.placed(df, "rank")
    labels = {r.node: r.label for r in components(simhash_index.code_links(placed.select("code", "pos"))).collect()}
    at = sorted((r.pos, r.code & (1 << 64) - 1) for r in placed.collect())
    grays = [c for _, c in at]
    ranks = [g ^ (g >> 1) ^ (g >> 2) ^ (g >> 3) for g in grays]  # only to see that order is that of ranks, by their leading bits
    assert [r >> 60 for r in ranks] == sorted(r >> 60 for r in ranks)
    assert [labels.get(p, p) for p, _ in at] == plain_components([p for p, _ in at], grays)


def plain_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_near_copies_are_those_of_a_plain_version(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["ala", "Bor", "céd", "dun", "Eli", "fur", "gox"]) + str(rng.randrange(9)) for _ in range(400)) for _ in range(12)]
    texts = [None, "", " \n ", "one", "Two words", "two WORDS", "three little words", "x" * 9000]
    for t in base:
        words = t.split()
        texts += [t, t.upper()] + [" ".join(w if rng.random() > 0.004 else "changed" for w in words) for _ in range(9)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_index.near_copies(rows_of(spark, [(i, t, None, None, None) for i, t in rows]).repartition(4)).collect()}
    rows.sort()
    codes = [plain_fingerprint(t) for _, t in rows]
    wanted = plain_components([i for i, _ in rows], codes)
    assert [got[i] for i, _ in rows] == [(f"{c:016x}", w) for c, w in zip(codes, wanted, strict=True)]
    assert len(set(wanted)) < len(set(codes))  # links between different fingerprints are there


def test_near_copies_of_nothing_and_of_null_ids(spark):
    assert simhash_index.near_copies(rows_of(spark, [])).collect() == []
    rows = [(None, "a b c d", None, None, None), (None, "a b c d", None, None, None), (5, "quite other words here", None, None, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_index.near_copies(rows_of(spark, rows)).collect())
    assert got == [(-1, None), (-1, None), (5, 5)]
