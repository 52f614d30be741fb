"""Services, the stored cache, chains, bands and books that can't be read, against plain versions."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bookflow.operators import batching, cache_table, chains, correct, footnotes, pages, pictures, policy
from bookflow.sources import dictionary, epub, mobi


def plain_batches(lengths, most):
    out, total, batch = [], 0, 0
    for n in lengths:
        if total > 0 and total + n > most:
            batch, total = batch + 1, 0
        total += n
        out.append(batch)
    return out


def test_batches_are_those_of_a_fold(spark):
    rng = random.Random(2)
    books = {f"b{k}": [rng.choice([0, 0, 3, 8, 25, 60]) for _ in range(rng.choice([1, 2, 300]))] for k in range(12)}
    rows = spark.createDataFrame([(b, k, "x" * n) for b, own in books.items() for k, n in enumerate(own)], "book string, ord int, t string")
    got = {}
    for r in batching.greedy_batches(rows, "book", "ord", "t", 20).orderBy("book", "ord").collect():
        got.setdefault(r.book, []).append(r.batch)
    assert got == {b: plain_batches(own, 20) for b, own in books.items()}
    assert batching.greedy_batches(rows.limit(0), "book", "ord", "t", 20).collect() == []


def test_a_long_chain_takes_few_rounds(spark):
    nodes = spark.range(50_000).select(F.lit("b").alias("book"), F.col("id").alias("node"), F.when(F.col("id") + 7 < 50_000, F.col("id") + 7).alias("next"))
    assert sorted(r.node for r in chains.reached(nodes, "book").collect()) == list(range(0, 50_000, 7))


def test_failing_blocks_stand_alone_and_others_are_answered(spark):
    rows = spark.createDataFrame([("b", k, f"line {k}" + (" bad" if k in (3, 17) else "")) for k in range(30)], "book string, ord int, text string")

    def model(request):
        if "bad" in request:
            raise RuntimeError("no")
        return request.replace("line", "LINE")

    got = {r.ord: (r.corrected, r.source, r.error) for r in correct.corrected_or_failed(rows, batching.greedy_batches(rows, "book", "ord", "text", 100_000), model).collect()}
    assert got == {k: (f"line {k} bad", "error", "RuntimeError: no") if k in (3, 17) else (f"LINE {k}", "llm", None) for k in range(30)}
    assert correct.corrected_or_failed(rows.limit(0), batching.greedy_batches(rows.limit(0), "book", "ord", "text"), model).collect() == []


def test_calls_keep_to_their_planned_starts(spark):
    rows = spark.createDataFrame([("b", k, "groq", "free", False, f"r{k}") for k in range(6)], "book string, batch int, service string, tier string, translates boolean, request string")
    plan = policy.planned(policy.allowed(rows, F.lit(0), F.lit(True)), ["service", "tier", "translates"], "book", "batch")
    assert [r.start_ms for r in plan.orderBy("batch").collect()] == [1200 * k for k in range(6)]
    answers = policy.kept_to(plan, lambda r: r.upper(), "batch int", began=0.0, clock=lambda: 10_000.0)
    assert sorted(tuple(r) for r in answers.collect()) == [(k, f"R{k}") for k in range(6)]
    for asked, want in ((0, 3), (9, 4), (2, 2)):
        paid = rows.withColumns({"service": F.lit("gemini"), "tier": F.lit("paid")})
        assert policy.allowed(paid, F.lit(asked), F.lit(True)).first().at_once == want
    unknown = rows.withColumns({"service": F.lit("local"), "tier": F.lit(None).cast("string")})
    assert policy.allowed(unknown, F.lit(4), F.lit(True)).select("at_once", "pause_ms").first() == (1, 1500)


def test_the_cache_is_rewritten_where_it_is_touched_and_never_shuffled(spark):
    name = "bookflow_cache_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    cache_table.create(spark, name)

    def files():
        rows = spark.table(name).select("part", F.input_file_name().alias("file")).distinct().collect()
        return {r.part: {x.file for x in rows if x.part == r.part} for r in rows}

    try:
        first = spark.range(500).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.lit("one").alias("corrected"), F.lit(1).alias("stamp"))
        assert cache_table.save(spark, name, first) == list(range(cache_table.PARTS))
        before = files()
        touched = cache_table.save(spark, name, spark.createDataFrame([("k7", "two", 2), ("k8", "old", 0), (None, "x", 5)], "cache_key string, corrected string, stamp long"))
        after = files()
        assert 1 <= len(touched) <= 2 and all((before[p] == after[p]) == (p not in touched) for p in before)
        assert cache_table.save(spark, name, first.limit(0)) == []
        asked = spark.createDataFrame([("k7",), ("k8",), ("k999",), (None,)], "key string")
        found = cache_table.looked_up(asked, F.col("key"), name)
        assert {r.key: r.cached_text for r in found.collect()} == {"k7": "two", "k8": "one", "k999": None, None: None}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        side = plan[plan.index("FileScan parquet spark_catalog") - 400 :] if "FileScan parquet spark_catalog" in plan else plan
        assert plan.count("Exchange hashpartitioning") == 1, side
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_marks_meet_the_lines_of_their_band(spark):
    lines = spark.createDataFrame([("b", 1, k, 50.0, 500.0, 14.0 * k) for k in range(200)], "book string, page int, line int, min_x double, max_x double, line_y double")
    marks = spark.createDataFrame([("b", 1, k, 100.0, 14.0 * k - 4) for k in range(200)], "book string, page int, mark int, x double, y double")
    found = pages.nearest_lines(marks, lines, ["book", "page"])
    assert sorted((r.mark, r.line) for r in found.collect()) == [(k, k) for k in range(200)]
    band = lambda y: F.floor(F.col(y) / pages.MARK_AWAY)
    met = marks.withColumn("band", F.explode(F.array(*(band("y") + k for k in (-1, 0, 1))))).join(lines.withColumn("band", band("line_y")), ["book", "page", "band"])
    assert met.count() < 3 * 200  # and not 200 times 200


def test_orphans_by_bands(spark):
    notes = spark.createDataFrame([("b", f"t{k}", k, k, f"n{k}") for k in range(100)], "book string, tag string, pos int, page int, note string")
    chapters = spark.createDataFrame([("b", 1, 0, 40), ("b", 2, 33, 70), ("b", 3, 71, 60)], "book string, chapter int, start_page int, end_page int")
    none = spark.createDataFrame([], "book string, tag string, pos int")
    got = {r.tag: r.chapter for r in footnotes.orphans(none, notes, chapters).collect()}
    assert got == {f"t{k}": 1 if k <= 40 else 2 for k in range(71)}


def test_word_lists(spark):
    words = spark.createDataFrame([(w,) for w in "zil cam çam ısı ile oku ödev su şu ud üzüm".split()], "word string")
    placed = {r.word: r.place for r in dictionary.in_order(spark.createDataFrame([(w,) for w in ("aç", "ac", "aı", "ai", "ağ", "ag")], "word string")).collect()}
    assert sorted(placed, key=placed.get) == ["ac", "aç", "ag", "ağ", "aı", "ai"]
    texts = spark.createDataFrame([(1, "Cam ÇAM cam xyz"), (2, "q"), (3, None)], "id int, t string")
    assert [tuple(r) for r in dictionary.known(texts, "id", "t", words).collect()] == [(1, 3, 2)]


def archive(pages_by_name):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(pages_by_name))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(pages_by_name)))
        z.writestr("c.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for n, content in pages_by_name.items():
            z.writestr(n, content)
    return out.getvalue()


def test_chapters_in_any_encoding(spark):
    text = "<p>Çok güzel şığ</p>"
    made = {"a.xhtml": text.encode(), "b.xhtml": f'<?xml version="1.0" encoding="ISO-8859-9"?>{text}'.encode("iso-8859-9"), "c.xhtml": b"<p>bad \xff byte</p>", "d.xhtml": text.encode("utf-16"), "e.xhtml": f"<meta charset=windows-1254>{text}".encode("cp1254"), "f.xhtml": b'<?xml encoding="no-such"?><p>x</p>'}
    files = spark.createDataFrame([("one", archive(made)), ("two", b"no archive")], "book string, content binary")
    entries = epub.entries(files)
    got = {r.href: (r.html, r.error) for r in epub.chapters(entries, epub.packages(entries)).collect()}
    assert all(text in got[n][0] and got[n][1] is None for n in ("a.xhtml", "b.xhtml", "d.xhtml", "e.xhtml"))
    assert got["c.xhtml"] == ("<p>bad � byte</p>", "not valid UTF-8: replaced") and "<p>x</p>" in got["f.xhtml"][0]


def test_bad_mobi_files_keep_their_rows(spark):
    files = spark.createDataFrame([("a", b""), ("b", b"x" * 50), ("c", b"x" * 100), ("d", None)], "book string, content binary")
    got = mobi.texts(files).collect()
    assert len(got) == 4 and all(r.html is None and r.error.startswith("no MOBI file") for r in got)
    assert mobi.chapters(files).collect() == []


@pytest.mark.parametrize(
    ("html", "titles"),
    [
        ("<h2>A</h2>" + "a" * 40 + "<mbp:pagebreak/><h1>One <b>b</b></h1>" + "b" * 40 + "<mbp:pagebreak/>short", ["A", "One b"]),
        ("<h1>One</h1>" + "a" * 40 + "<hr/><p>***" + "b" * 40 + '<div class="chapter"><h3>* * *</h3>' + "c" * 40, ["One", "Bölüm 2", "Bölüm 3"]),
        ("<h2>A</h2>" + "a" * 40 + "<h2>B</h2>" + "b" * 400 + "<h2>C</h2>" + "c" * 40, ["A", "C"]),
        ("tiny", ["Bölüm 1"]),
    ],
)
def test_three_ways_to_cut_a_book(spark, html, titles):
    parts = spark.createDataFrame([(html,)], "h string").select(mobi.split_chapters(F.col("h")).alias("p")).first().p
    assert [p.title for p in parts] == titles


def test_pixels_of_every_kind():
    rgb = lambda *a: pictures.to_rgb(*a).tolist()
    assert rgb("bit", 9, 1, b"\x80\x80") == [[[255] * 3] + [[0] * 3] * 7 + [[255] * 3]]
    assert rgb("grey", 2, 1, b"\x07") == [[[7] * 3, [0] * 3]]
    assert rgb("rgb", 1, 2, bytes(range(6))) == [[[0, 1, 2]], [[3, 4, 5]]]
    assert rgb("rgba", 2, 1, bytes([10, 20, 30, 0, 40, 50, 60, 0])) == [[[10, 20, 30], [40, 50, 60]]]
    assert rgb("rgba", 2, 1, bytes([10, 20, 30, 0, 40, 50, 60, 255])) == [[[255] * 3, [40, 50, 60]]]
    assert rgb("rgba", 1, 1, bytes([0, 0, 0, 51])) == [[[204] * 3]]
    assert rgb("cmyk", 1, 1, bytes([0, 255, 0, 0])) == [[[255, 0, 255]]] and rgb("cmyk", 1, 1, b"\0\0\0\xff") == [[[0] * 3]]
    file = pictures.bmp(pictures.to_rgb("rgb", 3, 2, bytes(range(18))))
    assert len(file) == 54 + 12 * 2 and file[54:57] == bytes([2, 1, 0]) and file[63:66] == b"\0\0\0"


def test_pictures_follow_their_page(spark):
    made = [("b", 1, 0, "grey", 30, 30, b"x"), ("b", 1, 1, "grey", 24, 30, b"x"), ("b", 2, 0, "jpx", 30, 30, b"x"), ("b", 2, 1, "rgb", 30, 30, None)]
    found = pictures.converted(spark.createDataFrame(made, "book string, page int, place int, kind string, width int, height int, data binary"))
    assert sorted((r.page, r.place, r.file is None, r.error is None) for r in found.collect()) == [(1, 0, False, True), (2, 0, True, False), (2, 1, True, False)]
    body = spark.createDataFrame([("b", 1, 0, "text", "a"), ("b", 1, 1, "note", "n"), ("c", 1, 0, "text", "z")], "book string, page int, ord int, kind string, text string")
    every = pictures.with_pictures(body, found)
    assert [(r.ord, r.kind) for r in every.filter("book = 'b' AND page = 1").orderBy("ord").collect()] == [(0, "text"), (1, "note"), (2, "picture")]
    assert sorted(tuple(r) for r in pictures.book_counts(every).collect()) == [("b", 1, 1), ("c", None, None)]
