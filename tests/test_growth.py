"""Cases of large inputs from the third review: each failed before, or took more than a test can."""

import pytest
from pyspark.sql import functions as F

from bookflow.functions import text as tx
from bookflow.functions.diff import text_diff
from bookflow.operators import batching, findings, footnotes, reports
from bookflow.plans import text_queries
from bookflow.sources import dictionary


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_only_suspects_are_sorted_into_categories(spark):
    words = [*reports.M_FOR_RN, *reports.UNMARKED, *"clear claim CLİP karamlik UMUK umdum umca durna burna VİRNİ virnı b1l 1b1h i2 9L 99 vv WVV ııı plain Kame KAMI kamiya somak CL".split()]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = frame.select("w", (F.size(reports.suspect_categories(F.col("w"))) > 0).alias("some"), F.col("w").rlike(reports.SUSPECT).alias("found")).collect()
    assert [r.w for r in got if r.some != r.found] == [] and {r.w for r in got if not r.some} >= {"99", "9L", "plain", "virnı", "kamiya", "somak", "CL"}


def test_many_places_in_a_block(spark):
    frame = spark.createDataFrame([(1, " ," * 50_000), (0, "a , b"), (2, None)], "k int, t string")
    got = findings.first_places(frame, ["k"], "t", 3).orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.match, r.n) for r in got] == [(0, 1, " ,", 50_001), (1, 0, " ,", 50_001), (1, 2, " ,", 50_001)]


@pytest.mark.parametrize("kind", findings.KINDS)
def test_counted_patterns_find_as_much(spark, kind):
    texts = ["ab- cd- e", "a-  b- c d-\n e", "x - y", "  , ,.  !", "a ,b \t;", "çok- şey-", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", F.regexp_count("t", F.lit(findings.KINDS[kind])).alias("a"), F.regexp_count("t", F.lit(findings.COUNTED[kind])).alias("b")).collect():
        assert r.a == r.b, r.t


def test_long_texts_with_only_more_tokens():
    whole = "a, b. " * 20_000
    runs, words = text_diff(whole.replace(", ", " ,, ").replace(". ", " . "), whole)
    assert len(runs) == 120_001 and words == 0  # a trail that grew with the square of the removals before
    assert text_diff("a b", "a c b") == ([("equal", "a "), ("added", "c "), ("equal", "b")], 1)


def test_words_stay_where_their_text_is(spark):
    words = spark.createDataFrame([("cam",), ("cam",), ("kaya",)], "word string")
    texts = spark.createDataFrame([(1, "Cam ÇAM cam xyz KAYA Kâya \u212aaya"), (1, "cam")], "id int, t string")
    out = dictionary.known(texts, "id", "t", words)
    assert shuffles(out) == 1  # pairs were joined with the list by word before
    assert [tuple(r) for r in out.collect()] == [(1, 5, 2)]


def test_a_book_of_many_blocks_is_batched(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("b").alias("book"), F.col("id").alias("ord"), F.lit("x" * 10).alias("text"))
    batches = {r.ord: r.batch for r in batching.greedy_batches(rows, "book", "ord", "text", 100_000).collect()}
    assert len(batches) == n and all(batch == ord // 10_000 for ord, batch in batches.items())  # a frame of all later blocks for each one before


def test_routes_are_made_once(spark):
    out = text_queries.joined_routes(spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()  # each use made them anew before


def test_trimmed_is_what_the_class_takes(spark):
    texts = [tx.WS_SIGNS + "a" + tx.WS_SIGNS + "b" + tx.WS_SIGNS, "\x85a\x1c", "​ a", "", tx.WS_SIGNS, None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.filter(~tx.trimmed(F.col("t")).eqNullSafe(F.regexp_replace("t", f"^{tx.WS}+|{tx.WS}+\\z", ""))).count() == 0
    assert spark.createDataFrame([(chr(c),) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "t string").filter(F.col("t").rlike(tx.WS)).count() == len(tx.WS_SIGNS)


def test_bodies_of_many_signs(spark):
    signs = "*<[" * 100_000
    texts = spark.createDataFrame([(f"[BLOCK_0]{signs}[/BLOCK_0]",), (f"[BLOCK_0]{signs}",)], "t string")
    assert [len(r.p[0]) for r in texts.select(batching.parse_response(F.col("t"), F.lit(1)).alias("p")).collect()] == [299_999] * 2


def test_lines_and_empty_bodies_stay_as_numbers_are_put_in(spark):
    bodies = spark.createDataFrame([(1, "b", "one\ntwo[^x]\n[^none]."), (2, "b", ""), (3, "c", "[^x]")], "k int, book string, t string")
    numbers = spark.createDataFrame([("b", "x", 7)], "book string, tag string, number int")
    out = footnotes.resolve(bodies, numbers, ["k"], "t")
    assert shuffles(out) == 1  # pieces and numbers were joined by book and tag before
    assert sorted(tuple(r) for r in out.collect()) == [(1, "one\ntwo[7]\n."), (2, ""), (3, "")]  # lines and the empty body went before


def test_notes_and_marks_meet_in_one_shuffle(spark):
    bodies = spark.createDataFrame([("b", 1, "a[^x] & [^none]"), ("b", 2, "[^y][^x]")], "book string, pos int, text string")
    notes = spark.createDataFrame([("b", "x", "X"), ("b", "y", "Y"), ("b", "a", "A")], "book string, tag string, note string")
    out = footnotes.linked(bodies, notes)
    assert shuffles(out) == 1  # marks and notes were joined before
    assert sorted((r.kind, r.ord, r.html) for r in out.collect()) == [
        ("body", 1, '<p>a<a id="ref-1-1" href="#note-1">[1]</a> &amp; </p>'), ("body", 2, '<p><a id="ref-2-1" href="#note-2">[2]</a><a id="ref-1-2" href="#note-1">[1]</a></p>'),
        ("note", 1, '<aside id="note-1"><p>1. X <a href="#ref-1-1">^</a> <a href="#ref-1-2">^</a></p></aside>'),
        ("note", 2, '<aside id="note-2"><p>2. Y <a href="#ref-2-1">^</a></p></aside>'), ("note", 3, '<aside id="note-3"><p>3. A</p></aside>'),
    ]
