"""Exact search, media round trips, token counts and piece encoding against plain versions."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from zstandard import ZstdCompressor

from bookflow.llm import media, pivot_search, sentencepiece_lattice, token_counts


def best_by_hand(rows, k=5):
    rows = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_search_is_exact_on_odd_vectors(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist() if i % 3 else same) for i in range(700)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None] * 4), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (None, same), (1050, [1.0, 2.0]), (1051, [3.0, 1.0]), (1100, [0.0] * 8), (1101, [1e6] * 8)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(map(tuple, pivot_search.top_k(frame, F.col("vec_id") % 50 == 0).collect()))
    assert got == best_by_hand(rows)
    small = pivot_search.top_k(frame, F.col("vec_id") % 50 == 0, sample=20, pivots=3, rings=2, first_rings=1)
    assert sorted(map(tuple, small.collect())) == got


def test_search_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pivot_search.top_k(frame, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 1, 128 * 256), (0, 2, 2, 128 * 256)]
    assert pivot_search.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (64, 64), (7, 2)])
def test_pictures_round_trip(shape):
    rng = np.random.default_rng(4)
    grey, colour = rng.integers(0, 256, shape, np.uint8), rng.integers(0, 256, (*shape, 3), np.uint8)
    for data, want in ((media.encode_pgm(grey), grey), (media.encode_bmp(grey), grey), (media.encode_ppm(colour), colour), (media.encode_bmp(colour), colour)):
        assert (media.decode(data) == want).all()
    text = f"P2 # note\n{shape[1]} {shape[0]}\n255\n" + " ".join(map(str, grey.ravel()))
    assert (media.decode(text.encode()) == grey).all()
    bits = grey % 2
    assert (media.decode(f"P1\n{shape[1]} {shape[0]}\n".encode() + "".join(map(str, 1 - bits.ravel())).encode()) == bits).all()
    assert (media.decode(f"P4\n{shape[1]} {shape[0]}\n".encode() + np.packbits(1 - bits, axis=1).tobytes()) == bits).all()


def test_area_resize_is_the_mean_of_areas():
    rng = np.random.default_rng(5)
    picture = rng.integers(0, 256, (12, 18)).astype(np.float64)
    assert np.allclose(media.area_resize(picture, 4, 6), picture.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(picture, 5, 0), 7, 1)
    assert np.allclose(media.area_resize(picture, 5, 7), fine.reshape(5, 12, 7, 18).mean(axis=(1, 3)))
    assert np.load(io.BytesIO(media.npy_tile(picture, 4))).shape == (4, 4) and len(media.difference_hash(picture)) == 16


def test_media_rows(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "long " * 100_000, "a"]
    frame = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    for form in ("pgm", "bmp"):
        rows = {r.doc_id: r for r in media.read_media(media.encode_media(frame, form=form)).collect()}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            whole = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert rows[2][1:] == rows[7][1:] and rows[0][1:] == rows[1][1:]
    bad = spark.createDataFrame([(1, 2, b"no picture"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.feature is None for r in media.read_media(bad).collect()) and media.read_media(bad.limit(0)).collect() == []


TEXTS = [None, "", " ", "  ", "a", "It's  the<|endoftext|> end\n\n \n x", "日本語 テキスト", "don't 123 ... !!", "word " * 30_000, "x" * 5000, "é☃😀 ▁▁a", "tab\tand nbsp 　 end ", "①" * 80, "abc" * 60 + "日本"]


def odd_texts():
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "a", "b'", "'s", "<|endoftext|>", "1", " \n", "\t", "é", "ё", " ", "　", "!", "...", "日", "☃", "▁", "the "]
    return TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["a", "a"]


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    texts = odd_texts()
    whole = Tokenizer.from_file(token_counts.default_tokenizer())
    frame = spark.createDataFrame([(i % 400, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(3)
    for limit in (5, 200_000):
        got = token_counts.count_tokens(frame, hot_limit=limit, hot_docs=1)
        want = sorted((i % 400, len((t or "").encode()), n, n > 1024) for i, t in enumerate(texts) for n in [len(whole.encode(t or "", add_special_tokens=False).ids)])
        assert sorted(map(tuple, got.collect())) == want
    assert token_counts.count_tokens(frame.limit(0)).collect() == []


def test_encoding_is_the_library_s(spark):
    from sentencepiece import SentencePieceProcessor

    texts, model = odd_texts(), SentencePieceProcessor(model_file=sentencepiece_lattice.default_model())
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "ids_of long, text string, ids string").repartition(3)
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(frame))
    for r in back.collect():
        want = None if r.text is None else model.encode(r.text)
        assert r.ids == want
        assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))
    docs = frame.withColumnRenamed("ids_of", "doc_id").drop("ids")
    for limit in (3, 200_000):
        counted = {r.doc_id: r for r in sentencepiece_lattice.count_encoded(docs, hot_limit=limit).collect()}
        assert len(counted) == len(texts)
        for i, t in enumerate(texts):
            ids = model.encode(t or "")
            assert (counted[i].n_pieces, counted[i].n_bytes, counted[i].complete) == (len(ids), sum(map(model.is_byte, ids)), True)
    assert sentencepiece_lattice.count_encoded(docs.limit(0)).collect() == []


def test_query_has_ids_in_order_and_decodes_them(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentencepiece_lattice.default_model())
    texts = ["one two qqzxv three qqzxv \u4e16", "three \u4e16 qqzxv two qqzxv one", None, "", "a  b\u2581c", "x" * 300 + " end " + "longer-word" * 9, "abcdefgh" * 40 + "  \n\n" + "é" * 70 + "=" * 200, "a\nb1234 -- 5.\r\nЖук🙂\u3000x\u200bz", "y" * 1_200_000 + " " * 90 + "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for limit in (2, 200_000):
        got = {r.doc_id: r for r in sentencepiece_lattice.count_encoded(docs, hot_limit=limit).collect()}
        assert [got[i].ids for i in range(len(texts))] == [model.encode(t or "") for t in texts]
        assert got[0].ids_digest != got[1].ids_digest and all(r.complete for r in got.values())
    path = sentencepiece_lattice.default_model()
    ids = model.encode("two one")
    hot = sentencepiece_lattice.Hot([("two one", 9, b"".join(i.to_bytes(3, "big") for i in ids))], [], path)
    pack = ZstdCompressor().compress
    for text, same in ((b"one two", False), (b"two one", True)):  # as many bytes, in another order
        rows = pa.RecordBatch.from_pydict({"d": [[1]], "print": [sentencepiece_lattice._fingerprint(text)], "sizes": [pack(np.array([1], "<i4").tobytes())], "codes": [pack(sentencepiece_lattice.short_codes(np.array([1])))], "slots": [pack(b"")], "found": [[]], "own": [[]]})
        (out,) = sentencepiece_lattice._filled(iter([rows]), path, hot.ids, hot.begins, hot.spelled)
        assert out.column(1).to_pylist() == [ids] and out.column(4).to_pylist() == [same]
    empty = sentencepiece_lattice.Hot([], [], path)
    assert empty.words == {} == empty.units and empty.begins.tolist() == [0, 0]


def test_small_bundles_give_the_same(spark, monkeypatch):
    texts = [t or "" for t in odd_texts()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    whole = {r.doc_id: r for r in sentencepiece_lattice.count_encoded(docs).collect()}
    monkeypatch.setattr(sentencepiece_lattice, "BUNDLE_BYTES", 90)
    monkeypatch.setattr(sentencepiece_lattice, "GROUP_WORDS", 9)
    monkeypatch.setattr(sentencepiece_lattice, "HOT_TIMES", 1)
    assert {r.doc_id: r for r in sentencepiece_lattice.count_encoded(docs, hot_limit=20, unit_limit=5).collect()} == whole and all(r.complete for r in whole.values())


def test_codes_and_ids_come_back_from_bytes():
    codes = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 5])
    for part in (codes, codes[:0], codes[:1]):
        assert sentencepiece_lattice.long_codes(sentencepiece_lattice.short_codes(part)).tolist() == part.tolist()
    assert sentencepiece_lattice.unpacked(bytes([0, 0, 7, 0, 125, 0, 3, 0, 1])).tolist() == [7, 32000, 196609] and len(sentencepiece_lattice.unpacked(b"")) == 0


def test_viterbi_fold_is_the_best_path(spark):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -6.0, "c": -2.5, "bc": -2.2, "ca": -0.5}
    order = sorted(scores, key=lambda p: -scores[p])
    table = spark.createDataFrame([(p, i, i, scores[p]) for i, p in enumerate(order)], "piece string, id int, rank long, score double")
    words = ["abc", "aabbcca", "cabcab", "axb", "x"]

    def best(word):
        paths = [(0.0, [])]
        for k in range(1, len(word) + 1):
            options = [(paths[k - 1][0] - 1e4, [*paths[k - 1][1], None])]
            options += [(paths[j][0] + scores[word[j:k]], [*paths[j][1], word[j:k]]) for j in range(k) if word[j:k] in scores]
            paths.append(max(options, key=lambda o: o[0]))
        return paths[-1][1]

    edges = sentencepiece_lattice.lattice(spark.createDataFrame([(w,) for w in words], "unit string"), table.select("piece", "id", "rank"), 3)
    for r in edges.withColumn("path", sentencepiece_lattice.fold_viterbi(table)).collect():
        assert [None if e < 0 else order[e >> 45] for e in r.path] == best(r.unit)


def test_a_pixel_beyond_the_palette_gives_nulls(spark):
    data = bytearray(media.encode_bmp(np.full((2, 4), 200, np.uint8)))
    data[46:50] = (2).to_bytes(4, "little")
    rows = spark.createDataFrame([(1, 8, bytes(data)), (2, 8, media.encode_bmp(np.full((2, 4), 200, np.uint8)))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r.payload_bytes for r in media.read_media(rows).collect()}
    assert got == {1: None, 2: 8}
