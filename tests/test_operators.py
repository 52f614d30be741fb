"""Operators of the library on small known tables."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from bookflow.functions import diff, registration
from bookflow.functions import text as tx
from bookflow.operators import answers, batching, cache, correct, findings, footnotes, layout, pages, reports, stitch
from bookflow.sinks import books
from bookflow.sources import dictionary, epub, html_blocks, mobi
from bookflow.streaming import blocks as streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert value(spark, tx.trimmed(F.lit("  a﻿\n"))) == "a"
    assert value(spark, tx.turkish_lower(F.lit("IİĞ"))) == "ıiğ"
    assert value(spark, tx.word_count(F.lit(" a b \n c "))) == 3 and value(spark, tx.word_count(F.lit(None).cast("string"))) == 0
    assert value(spark, tx.decode_entities(tx.strip_tags(F.lit("<b>a &amp;lt; b</b>")))) == "a &lt; b"
    assert value(spark, tx.escape_xml(F.lit("<a&'\">"))) == "&lt;a&amp;&apos;&quot;&gt;"
    assert [value(spark, tx.round_half_up(F.lit(x))) for x in (2.5, -2.5, 0.49)] == [3, -2, 0]
    assert [value(spark, tx.duration(F.lit(x))) for x in (65.9, 59, -1, None)] == ["1 dk 5 sn", "59 sn", "0 sn", "0 sn"]
    assert value(spark, tx.file_size(F.lit(1572864))) == "1.50 MB" and value(spark, tx.file_size(F.lit(2048))) == "2 KB"
    assert value(spark, tx.output_name(F.lit("a.b.pdf"))) == "a.b_duzeltilmis" and value(spark, tx.output_name(F.lit("x.epub"), F.lit("en"))) == "x_en_cevrilmis"
    assert [value(spark, tx.number_or_zero(F.lit(x))) for x in ("1.5", "x", None)] == [1.5, 0.0, 0.0]
    assert value(spark, tx.cache_key(F.lit(""), F.lit(" a  b "), "tr")).startswith("tr_default_") and value(spark, tx.cache_key(F.lit("m"), F.lit(""))) == "m_1505_0"


def stitched_by_hand(rows):
    out = []
    for text, heading in rows:
        t = text.strip()
        if not t:
            continue
        last = next((x for x in reversed(out) if not x[1]), None)
        if not heading and last:
            if last[0].endswith("-"):
                last[0] = last[0][:-1] + t
                continue
            if last[0][-1] not in ".?!:»\"'" and t[0] in "abcdefghijklmnopqrstuvwxyzçğıöşü":
                last[0] += " " + t
                continue
        out.append([t, heading])
    return sorted(map(tuple, out))


def pairs_by_hand(rows):
    rows, taken, k = list(rows), set(), 0
    while k < len(rows) - 1:
        if rows[k].endswith("-") and len(rows[k]) > 1 and rows[k][-2].isalnum() and rows[k + 1][:1].islower():
            rows[k], rows[k + 1] = rows[k][:-1] + rows[k + 1], ""
            taken.add(k + 1)
            k += 1
        k += 1
    return [(t, i in taken) for i, t in enumerate(rows)]


def batches_by_hand(lengths, most):
    out, batch, total = [], 0, 0
    for n in lengths:
        if total > 0 and total + n > most:
            batch, total = batch + 1, 0
        total += n
        out.append(batch)
    return out


def test_windows_equal_the_folds(spark):
    rng = random.Random(11)
    pieces = ["ab-", "cde", "Fgh", "xyz.", "lower one", "Upper two-", "end!", "a1-", "q r"]
    books_ = {b: [(rng.choice(pieces), rng.random() < 0.15) for _ in range(rng.randint(1, 40))] for b in range(30)}
    rows = spark.createDataFrame([(b, k, t, h) for b, lines in books_.items() for k, (t, h) in enumerate(lines)], "book int, ord int, t string, h boolean").repartition(4)
    got = stitch.stitch_paragraphs(rows, "book", "ord", "t", F.col("h")).collect()
    merged = stitch.merge_hyphen_pairs(rows, "book", "ord", "t").collect()
    parts = batching.greedy_batches(rows, "book", "ord", "t", 20).collect()
    for b, lines in books_.items():
        assert sorted((r.text, r.is_heading) for r in got if r.book == b) == stitched_by_hand(lines)
        assert [(r.text, r.is_merged) for r in sorted(merged, key=lambda r: r.ord) if r.book == b] == pairs_by_hand([t for t, _ in lines])
        assert [r.batch for r in sorted(parts, key=lambda r: r.ord) if r.book == b] == batches_by_hand([len(t) for t, _ in lines], 20)


@pytest.mark.parametrize("response,n,want", [
    ("[BLOCK_0]a[/BLOCK_0]\n[BLOCK_1]b[/BLOCK_1]", 2, ["a", "b"]), ("<BLOCK_0>a</BLOCK_0><BLOCK_1>b</BLOCK_1>", 2, ["a", "b"]),
    ("[BLOK_0] a [/BLOK_0]", 1, ["a"]), ("[BLOCK_0]a\n[BLOCK_1]b", 2, ["a", "b"]), ("```html\n[BLOCK_0]a[/BLOCK_0]\n```", 1, ["a"]),
    ("**[BLOCK_0]**a**[/BLOCK_0]**", 1, ["a"]), ("[BLOCK_0]: a[/BLOCK_0]", 1, ["a"]), ("[BLOCK_1]a[/BLOCK_1][BLOCK_2]b[/BLOCK_2]", 2, ["a", "b"]),
    ("just text", 1, ["just text"]), ("one\n\ntwo", 2, ["one", "two"]), ("one\n\ntwo", 3, ["", "", ""]), ("[BLOCK_0]old[/BLOCK_0][BLOCK_0]new[/BLOCK_0]", 1, ["new"]),
    ("[BLOCK_1]b[/BLOCK_1][BLOCK_3]d[/BLOCK_3]", 3, ["b", "b", "d"]), ("", 2, ["", ""]), ("".join(f"[BLOCK_{k}]t{k}[/BLOCK_{k}]" for k in range(25)), 25, [f"t{k}" for k in range(25)]),
])
def test_parse_response(spark, response, n, want):
    assert value(spark, batching.parse_response(F.lit(response), F.lit(n))) == want


def test_prompt_has_its_sections(spark):
    made = value(spark, batching.prompt(F.lit("[BLOCK_0]x"), F.lit("en"), F.lit("xx"), F.lit("literary"), F.lit("Book"), F.lit(None).cast("string"), F.create_map(F.lit("Muggle"), F.lit("Muggle")), F.array(F.struct(F.lit("s").alias("c0"), F.lit("t").alias("c1")))))
    assert all(p in made for p in ("İngilizce", "Target: xx", "Title: Book", "- Muggle -> Muggle", "[Before 1]\nSource: s\nText: t", "[BLOCKS]\n[BLOCK_0]x")) and "Chapter:" not in made


def test_diff_is_shortest():
    rng = random.Random(12)
    assert diff.text_diff("same text", "same text") == ([("equal", "same text")], 0) and diff.text_diff(None, "") == ([], 0)
    assert diff.text_diff("a b c", "a x c") == ([("equal", "a "), ("removed", "b"), ("added", "x"), ("equal", " c")], 1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        runs = diff.edits(a, b)
        assert "".join(t for k, t in runs if k != "added") == "".join(a) and "".join(t for k, t in runs if k != "removed") == "".join(b)
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                common[i + 1][j + 1] = common[i][j] + 1 if a[i] == b[j] else max(common[i][j + 1], common[i + 1][j])
        assert sum(len(t) for k, t in runs if k == "equal") == common[-1][-1]


def test_cache_keeps_the_latest(spark):
    old = spark.createDataFrame([("k", "a", 1), ("m", "b", 5)], "cache_key string, corrected string, stamp int")
    fresh = spark.createDataFrame([("k", "c", 2), ("m", "d", 4)], old.schema)
    assert sorted((r.cache_key, r.corrected) for r in cache.upserted(old, fresh).collect()) == [("k", "c"), ("m", "b")]
    assert cache.stats(old).first().size_kb == 2


def test_reports(spark):
    rows = spark.createDataFrame([("c", 0, "Head", True, "completed", 1), ("c", 1, "x" * 80, False, "pending", 2), ("d", 0, "t", False, "completed", 0)], "chapter string, block_no int, original_text string, is_heading boolean, status string, diff_count int")
    got = {r.chapter: r for r in reports.chapter_stats(rows, ["chapter"]).collect()}
    assert (got["c"].total_blocks, got["c"].processed_blocks, got["c"].fixed_words, got["c"].complete, got["c"].progress, got["c"].title) == (2, 1, 3, False, 50, "Head")
    assert got["d"].complete and got["d"].title is None
    events = spark.createDataFrame([("convert", 25.0), ("translate", 2e6), ("other", 5.0), ("convert", None), ("convert", -3.0)], "a string, w double")
    assert tuple(reports.global_counters(events, F.col("a"), F.col("w")).first()) == (3, 1, 100025)
    assert tuple(reports.global_counters(events.limit(0), F.col("a"), F.col("w")).first()) == (0, 0, 0)


def test_pages(spark):
    rows = spark.createDataFrame([("BÖLÜM 1", 12.0, 100.0, True), ("İKİNCİ BÖLÜM", 12.0, 100.0, True), ("Bölüm 3", 12.0, 40.0, False), ("bölüm 1", 12.0, 100.0, False), ("Kısım: notlar", 12.0, 100.0, False), ("IV.", 18.0, 100.0, True), ("IV.", 12.0, 100.0, False), ("Yeni Bir Gün", 22.0, 100.0, True), ("Bir şey oldu", 22.0, 100.0, False), ("K A R A N L I K", 22.0, 90.0, True), ("G İ R İ Ş", 12.0, 90.0, True), ("Sonuç:", 12.0, 90.0, True)], "t string, font double, y double, want boolean")
    got = rows.withColumn("got", pages.is_chapter_heading(F.col("t"), F.col("font"), F.lit(12.0), F.col("y"))).collect()
    assert [(r.t, r.font) for r in got if r.got != r.want] == []
    lines = spark.createDataFrame([("- 12 -", 790.0, True), ("xii", 10.0, True), ("Sayfa 3", 10.0, True), ("Running head", 10.0, True), ("A sentence.", 10.0, False), ("12", 400.0, False), ("12", 730.0, True), ("body text", 400.0, False)], "t string, y double, want boolean")
    head = pages.is_header_or_footer(F.col("t"), F.col("y"), F.lit(11.0), F.lit(800.0), F.lit(12.0), F.lit(12), 0.05, 0.04)
    assert [r.t for r in lines.withColumn("got", head).collect() if r.got != r.want] == []
    contents = spark.createDataFrame([("b", 0, "İçindekiler"), ("b", 1, "One ..... 12"), ("b", 2, "Two ....... 5"), ("b", 3, "Three...30")], "book string, n int, t string")
    assert sorted(map(tuple, pages.table_of_contents(contents, "book", "n", "t").collect())) == [("b", 12, 0), ("b", 30, 0)]


def test_footnotes(spark):
    references = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("b", "x", 3), ("b", "z", 4)], "book string, tag string, pos int")
    definitions = spark.createDataFrame([("b", "x", 1, 1, "old"), ("b", "x", 9, 2, "new"), ("b", "q", 3, 4, "lost"), ("b", "r", 5, 99, "nowhere")], "book string, tag string, pos int, page int, note string")
    chapters = spark.createDataFrame([("b", 1, 1, 4), ("b", 2, 4, 9)], "book string, chapter int, start_page int, end_page int")
    assert sorted((r.tag, r.number, r.note) for r in footnotes.numbered(references, definitions).collect()) == [("x", 1, "new"), ("y", 2, None), ("z", 3, None)]
    assert [tuple(r) for r in footnotes.orphans(references, definitions, chapters).collect()] == [("b", "q", "lost", 1)]
    body = spark.createDataFrame([("b", 1, "see[^y] and[^none][^x]."), ("b", 2, "plain")], "book string, k int, t string")
    assert sorted((r.k, r.t) for r in footnotes.resolve(body, footnotes.numbered(references, definitions), ["k"], "t").collect()) == [(1, "see[2] and[1]."), (2, "plain")]


def as_lines(spark, rows, page, median):
    rows = [("b", page, k, float(y), float(a), float(b), float(font), text, float(median)) for k, (y, a, b, font, text) in enumerate(rows)]
    return spark.createDataFrame(rows, "book string, page int, line_no int, y double, min_x double, max_x double, font double, text string, median double")


def read_page(spark, rows, page, median, height):
    return [(r.text, r.note) for r in layout.line_paragraphs(as_lines(spark, rows, page, median), height).orderBy("ord").collect()]


def test_page_relations(spark):
    found = read_page(spark, [(100, 50, 500, 12, "Bir söz[^1] var."), (120, 50, 480, 12, "ve devam"), (550, 50, 450, 9, "1. Not metni"), (560, 50, 450, 9, "sürer")], 12, 12, 600)
    assert found == [("Bir söz[^p12_1] var. ve devam", None), ("[^p12_1]: Not metni sürer", "p12_1")]
    assert read_page(spark, [(100, 50, 500, 12, "Taş atıldı1 ve gitti."), (550, 50, 450, 12, "1. Not")], 5, 12, 600)[0][0] == "Taş atıldı[^p5_1] ve gitti."
    assert "[^" not in read_page(spark, [(100, 50, 500, 12, "Cilt 1 sayfa 20 Madde 1 oldu"), (550, 50, 450, 9, "1. Not")], 1, 12, 600)[0][0]
    ruled = read_page(spark, [(100, 50, 500, 12, "Metin."), (300, 50, 200, 12, "-----"), (320, 50, 450, 12, "* Yıldız"), (340, 50, 450, 12, "gövde")], 3, 12, 600)
    assert ruled == [("Metin.", None), ("gövde", None), ("[^p3_1]: Yıldız", "p3_1")]
    two = read_page(spark, [(100, 52, 500, 16, "Bir uzun satır burada bitti."), (125, 58, 495, 16, "aynı paragraf."), (165, 85, 490, 16, "Yeni paragraf.")], 1, 16, 600)
    assert [t for t, _ in two] == ["Bir uzun satır burada bitti. aynı paragraf.", "Yeni paragraf."]
    cut = read_page(spark, [(100, 50, 500, 12, "BÖLÜM 1"), (120, 50, 500, 12, "güzel ki-"), (134, 50, 500, 12, "tap ve ge-"), (148, 50, 500, 12, "Ali"), (162, 50, 500, 12, "12"), (176, 50, 500, 12, "— Dedi ki")], 1, 12, 800)
    assert [t for t, _ in cut] == ["BÖLÜM 1", "güzel kitap ve ge - Ali", "— Dedi ki"]
    toc = read_page(spark, [(100, 50, 500, 12, "İçindekiler"), (120, 50, 500, 30, "BÖLÜM 1.....3")], 1, 12, 800)
    assert [t for t, _ in toc] == ["İçindekiler", "BÖLÜM 1.....3"]


def test_lines_of_items(spark):
    items = [("b", 1, "Merhaba", 50.0, 100.0, 60.0, 12.0), ("b", 1, "dünya", 114.0, 100.5, 40.0, 12.0), ("b", 1, "2", 155.0, 96.0, 4.0, 7.0), ("b", 1, "uzak", 400.0, 100.0, 30.0, 12.0), ("b", 1, "3", 700.0, 300.0, 4.0, 7.0), ("b", 1, None, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(items, "book string, page int, text string, x double, y double, width double, font double")
    assert [r.text for r in layout.page_lines(frame).orderBy("line_no").collect()] == ["Merhaba dünya[^2]", "uzak", "3"]
    assert layout.page_lines(frame.limit(0)).count() == 0


def plain_chapters(rows, fixed, pages):
    """Starts found one after the other."""
    out, at = [], 0
    seen = False
    while at < len(rows):
        begin = rows[at][0] if at == 0 else rows[at - 1][0] + 1
        end, heading = len(rows), False
        for k in range(at, len(rows)):
            if fixed and k - at >= 19 and rows[k][0] >= begin + pages or not fixed and not seen and k - at >= 34 and rows[k][0] % pages == 0:
                end = k + 1
                break
            if not fixed and rows[k][1] and k - at >= 2:
                end, heading = k, True
                break
        out.append((at, end - at))
        at, seen = end, seen or heading
    return out


@pytest.mark.parametrize("fixed", [True, False])
def test_chapters_are_those_found_one_after_the_other(spark, fixed):
    rng = random.Random(5)
    rows = {f"b{k}": [(1 + i // rng.choice([3, 4]), i > 100 * (k % 2) and rng.random() < 0.04) for i in range(rng.choice([1, 30, 400]))] for k in range(8)}
    rows = {b: sorted(r) for b, r in rows.items()}
    frame = spark.createDataFrame([(b, p, n, "heading" if h else "text", f"BÖLÜM {n}" if h else f"p{n}", None) for b, own in rows.items() for n, (p, h) in enumerate(own)], "book string, page int, ord int, kind string, text string, note string")
    got = {}
    for r in layout.chapters(frame, fixed, 5).orderBy("book", "chapter").collect():
        got.setdefault(r.book, []).append(r.n_paragraphs)
    assert got == {b: [n for _, n in plain_chapters(own, fixed, 5)] for b, own in rows.items()}


def test_chapter_names(spark):
    body = [("b", k // 2 + 1, k, "text", f"p{k}", None) for k in range(50)]
    schema = "book string, page int, ord int, kind string, text string, note string"
    headed = [("b", 1, 0, "heading", "BÖLÜM 1", None), *[("b", 1, k + 1, "text", "x", None) for k in range(4)], ("b", 3, 9, "heading", "BÖLÜM 2", None), ("b", 3, 10, "text", "y", None)]
    got = layout.chapters(spark.createDataFrame(headed, schema)).orderBy("chapter").collect()
    assert [(r.title, r.first_page, r.last_page) for r in got] == [("BÖLÜM 1", 1, 3), ("BÖLÜM 2", 3, 3)]
    got = layout.chapters(spark.createDataFrame(body, schema), True, 3).orderBy("chapter").collect()
    assert [r.title for r in got][:2] == ["Kısım 1 (Sayfa 1-3)", "Kısım 2 (Sayfa 11-13)"]


def test_layout_frames(spark):
    items = [("b", page, f"word{k}", 50.0 + 60 * (k % 6), 100.0 + 20 * (k // 6), 50.0, 12.0) for page in (1, 2) for k in range(18)]
    frame = spark.createDataFrame(items, "book string, page int, text string, x double, y double, width double, font double")
    assert layout.page_lines(frame).count() == 6
    paragraphs = layout.page_paragraphs(frame, 800.0)
    assert paragraphs.count() == 2 and [r.n_paragraphs for r in layout.chapters(paragraphs).collect()] == [2]


HTML = '<html><head><title>Test Book</title></head><body><div><h1>One</h1><p></p><div>First text</div><div>Second <b>text</b></div><figure><img src="x"/></figure><pre>code</pre><p>a<code>b</code></p><ul><li>item<p>inner</p></li></ul><aside>note</aside></div></body></html>'


def test_html_blocks(spark):
    assert html_blocks.tree_blocks(HTML) == [("h1", "One", "pending"), ("div", "First text", "pending"), ("div", "Second text", "pending"), ("figure", "[Görsel]", "completed"), ("li", "iteminner", "pending"), ("aside", "note", "completed")]
    assert html_blocks.tree_blocks(None) == [] and value(spark, html_blocks.page_title(F.lit(HTML))) == "Test Book"
    assert value(spark, html_blocks.page_title(F.lit("<h2>A &amp; B</h2>"))) == "A & B"


def test_epub_and_mobi_round_trip(spark):
    chapters = spark.createDataFrame([("b", "My & Book", "Me", k, f"Chapter {k} <x>", f"<h1>Head {k}</h1><p>Çok güzel {k} &amp; more text to fill it.</p>") for k in range(3)], "book string, title string, creator string, chapter_no int, chapter_title string, html string")
    files = books.packaged(chapters).withColumnRenamed("file", "content")
    with zipfile.ZipFile(io.BytesIO(files.first().content)) as archive:
        first = archive.infolist()[0]
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and archive.testzip() is None
    entries = epub.entries(files)
    package = epub.packages(entries)
    assert (package.first().title, package.first().creator, len(package.first().spine)) == ("My & Book", "Me", 3)
    found = sorted((r.chapter_no, r.block_no, r.tag, r.text) for r in epub.blocks(epub.chapters(entries, package)).collect())
    assert found[:2] == [(0, 0, "h1", "Head 0"), (0, 1, "p", "Çok güzel 0 & more text to fill it.")] and len(found) == 6
    back = mobi.chapters(books.packaged(chapters, "mobi").withColumnRenamed("file", "content")).collect()
    assert [(r.title, r.creator, r.chapter_title) for r in sorted(back, key=lambda r: r.chapter_no)][0] == ("My & Book", "Me", "Chapter 0 &lt;x&gt;") and len(back) == 3
    assert epub.resolve("OEBPS/text", "../img/./a.png") == "OEBPS/img/a.png"
    rebuilt = books.chapter_html(spark.createDataFrame([("b", 0, 0, "p", "a < b", False), ("b", 0, 1, "p", "gone", True), ("b", 0, 2, "figure", "<img/>", False)], "book string, chapter_no int, block_no int, tag string, text string, is_merged boolean"))
    assert rebuilt.first().html == "<p>a &lt; b</p>\n<figure><img/></figure>"


def test_palmdoc():
    assert mobi.decompress(b"abc") == b"abc" and mobi.decompress(b"\x02\xc3\xa7d") == "çd".encode()
    assert mobi.decompress(b"a\xe2") == b"a b" and mobi.decompress(b"abc" + bytes([0x80 | (3 << 3) >> 8, (3 << 3 | 2) & 255])) == b"abcabcab"


def test_correction(spark):
    rows = spark.createDataFrame([("b", k, f"the line {k}") for k in range(10)], "book string, ord int, text string")
    done = correct.corrected(rows, batching.greedy_batches(rows, "book", "ord", "text", 30), correct.by_table({"the": "THE"}))
    assert sorted((r.ord, r.corrected) for r in done.collect()) == [(k, f"THE line {k}") for k in range(10)]
    calls, waits = [], []

    def shaky(request):
        calls.append(request)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert correct.with_retries(shaky, sleep=waits.append)("x") == "ok" and waits == [2.0, 3.6]


def test_dictionary(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" kitap \n\nev\nkitap\n", encoding="utf8")
    assert sorted(r.word for r in dictionary.load(spark, str(tmp_path)).collect()) == ["ev", "kitap"]
    words = dictionary.build(spark.createDataFrame([("Kâğıt İĞNE a 12 IŞIK",)], "t string"), "t")
    assert sorted(r.word for r in words.collect()) == ["iğne", "kağıt", "ışık"]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.createDataFrame([("convert", 5.0), ("convert", 2e6), ("translate", 1.0)], "a string, w double")
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.read_blocks(spark, str(tmp_path / "in"), "a string, w double")
    query = streams.counters(stream, F.col("a"), F.col("w")).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("totals").collect())) == [("convert", 2, 100005), ("translate", 1, 1)]
    texts = spark.createDataFrame([("a , b",), ("fine",)], "t string")
    texts.write.parquet(str(tmp_path / "texts"))
    out = streams.write_batches(streams.cleaned(streams.read_blocks(spark, str(tmp_path / "texts"), "t string"), "t"), str(tmp_path / "out"), str(tmp_path / "check"))
    out.awaitTermination()
    assert sorted((r.cleaned, r.has_anomaly) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a, b", False), ("fine", False)]


def test_block_answers(spark):
    rows = [
        ("<h2 class='x'> Head </h2>", "h2", "Head", "Head"), ("[BLOCK_3]<P>a &amp;lt; <b>b</b></P>[/BLOCK_3]", "p", "a &amp;lt; <b>b</b>", "a &lt; b"),
        ("<div>d</div>", "li", "<div>d</div>", "d"), ("bare", "li", "bare", "bare"), ("", "li", "", ""), (None, "li", "", ""), ("<BLOK 2>t</BLOK 2>", "li", "t", "t"),
    ]
    frame = spark.createDataFrame(rows, "raw string, tag string, inner string, text string")
    got = frame.select("tag", "inner", "text", answers.block_answer(F.col("raw"), "li").alias("a")).collect()
    assert [(r.a.tag, r.a.inner, r.a.text) for r in got] == [(r.tag, r.inner, r.text) for r in got]


def test_places_by_hand(spark):
    texts = ["a , b yapı- lamaz.", "", None, " , ,", "x" * 50 + " ; " + "y" * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for kind, pattern in (("hyphen split", r"[a-zA-ZçğıöşüÇĞİÖŞÜ]+-\s+[a-zA-ZçğıöşüÇĞİÖŞÜ]+"), ("space before punctuation", r"\s+[,.!?:;]")):
        want = [(n, m.start(), m[0], t[max(0, m.start() - 30) : m.end() + 30]) for n, t in enumerate(texts) for m in re.finditer(pattern, t or "")]
        assert sorted((r.k, r.pos, r.match, r.snippet) for r in findings.places(frame, ["k"], "t", kind).collect()) == want
    assert findings.first_places(frame, ["k"], "t", 2).filter("kind like 'space%'").count() == 2


def test_models_in_turn_and_named_waits():
    def fails(request):
        raise ValueError(request)

    assert correct.in_turn(fails, fails, str.upper)("a") == "A"
    with pytest.raises(ValueError):
        correct.in_turn(fails, fails)("a")
    waits, error = [], ValueError("later")
    error.retry_after = "7"
    tries = iter([error, ValueError("now"), None])

    def sometimes(request):
        e = next(tries)
        if e:
            raise e
        return request

    assert correct.with_retries(sometimes, sleep=waits.append)("a") == "a" and waits == [7.0, 3.6]


def test_routes_figures_and_scanned_pages(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "n int")
    is_ = lambda k: F.col("n") == k
    route = reports.route(F.lit("smart"), is_(4), is_(0), is_(3), F.lit(False), is_(1), is_(2))
    assert [r[0] for r in rows.orderBy("n").select(route).collect()] == ["skip", "figure", "kept", "cache", "model", "done"]
    items = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 9)], "book string, page int")
    sizes = spark.createDataFrame([("a", 2), ("b", 10), ("c", 1), ("d", 0)], "book string, n_pages int")
    found = sorted(map(tuple, pages.scanned_pages(items, sizes, "book", "page").collect()))
    assert found == [*(("b", k) for k in (1, 10, 2, 3, 4, 5, 6, 7, 8)), ("c", 1)] or found == [*(("b", k) for k in (1, 2, 3, 4, 5, 6, 7, 8, 10)), ("c", 1)]
    done = spark.createDataFrame([(True,), (False,), (True,)], "complete boolean")
    assert tuple(reports.completed_chapters(done).first()) == (2, 3)
    log = spark.createDataFrame([(1, "x"), (3, "b"), (3, "a"), (2, "y")], "t int, m string")
    assert [r.m for r in reports.newest_first(log, "t", 3).collect()] == ["a", "b", "y"]


def test_footnotes_numbered_by_definition(spark):
    references = spark.createDataFrame([("b", "x", 1), ("b", "z", 2), ("b", "y", 3)], "book string, tag string, pos int")
    definitions = spark.createDataFrame([("b", "y", 5, "why"), ("b", "x", 6, "ex"), ("b", "y", 7, "again")], "book string, tag string, pos int, note string")
    got = footnotes.numbered_by_definition(references, definitions).orderBy("number").collect()
    assert [(r.tag, r.number, r.note) for r in got] == [("y", 1, "why"), ("x", 2, "ex"), ("z", 3, "")]


def test_bad_archives_keep_their_rows(spark):
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as archive:
        archive.writestr("mimetype", "application/epub+zip")
    good = books.epub_bytes(books.epub_files("T", None, "tr", "1", [("One", "<p>some text</p>")]))
    frame = spark.createDataFrame([("a", b"no archive"), ("b", broken.getvalue()), ("c", good), ("d", None)], "book string, content binary")
    entries = epub.entries(frame)
    packages = {r.book: r for r in epub.packages(entries).collect()}
    assert sorted(packages) == ["a", "b", "c", "d"] and packages["c"].error is None and packages["c"].title == "T"
    assert all(packages[k].error for k in "abd") and "container" in packages["b"].error
    assert [r.text for r in epub.blocks(epub.chapters(entries, epub.packages(entries))).collect()] == ["some text"]


def test_deep_pages_and_far_texts():
    assert html_blocks.tree_blocks("<div>" * 5000 + "<p>deep text</p>") == [("p", "deep text", "pending")]
    a, b = " ".join(f"a{k}" for k in range(700)), " ".join(f"b{k}" for k in range(700))
    runs, fixed = diff.text_diff(a, b)
    assert fixed == 700 and "".join(t for k, t in runs if k != "added") == a and "".join(t for k, t in runs if k != "removed") == b


def test_diffs_of_equal_texts_and_nulls(spark):
    frame = spark.createDataFrame([("a b", "a b"), ("", ""), (None, ""), (None, "x y"), ("a b", "a c b")], "a string, b string")
    got = [(r.d.fixed_words, [(x.type, x.value) for x in r.d.diffs]) for r in frame.select(diff.diff_column(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [(n, runs) for runs, n in (diff.text_diff(*r) for r in [("a b", "a b"), ("", ""), (None, ""), (None, "x y"), ("a b", "a c b")])]


def test_pages_split_over_batches(spark):
    words = [("b", k // 40 + 1, f"w{k}", 50.0 + k % 10 * 40, 60.0 + k // 10 % 4 * 14, 34.0, 11.0) for k in range(400)]
    frame = spark.createDataFrame(words, "book string, page int, text string, x double, y double, width double, font double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, whole = spark.conf.get(key), sorted(map(tuple, layout.page_lines(frame).collect()))
    spark.conf.set(key, "7")
    try:
        assert sorted(map(tuple, layout.page_lines(frame).collect())) == whole and len(whole) == 40
        assert layout.page_paragraphs(frame, 800.0).count() > 0
    finally:
        spark.conf.set(key, before)


def test_blocks_put_back_into_their_page(spark):
    page = "<html><body>\n<nav>x</nav><div class='a'><p id=1>one <b>b</b></p><p>two<p>three</p><figure><img src=1></figure><div>four</div><li>five<br/>x</body></html>"
    found = html_blocks.tree_blocks(page)
    assert [(t, x) for t, x, _ in found] == [("p", "one b"), ("p", "two"), ("p", "three"), ("figure", "[Görsel]"), ("div", "four"), ("li", "fivex")]
    assert html_blocks.rebuilt(page, [(t, None, False) for t, *_ in found]) == page
    changed = html_blocks.rebuilt(page, [("p", "1", False), ("h2", "2", False), ("p", "", True), ("figure", "y", False), ("div", "4", False)])
    assert changed == "<html><body>\n<nav>x</nav><div class='a'><p id=1>1</p><h2>2</h2><figure><img src=1></figure><div>4</div><li>five<br/>x</body></html>"
    assert html_blocks.rebuilt("", [("p", "1", False)]) == "" and html_blocks.rebuilt("<p>a < b</p>", [("p", "c", False)]) == "<p>c</p>"
    chapters = spark.createDataFrame([("b", 1, page), ("b", 2, "<p>as it was</p>")], "book string, chapter_no int, html string")
    blocks = spark.createDataFrame([("b", 1, 1, "p", "second", False), ("b", 1, 0, "p", "first", None)], "book string, chapter_no int, block_no int, tag string, html string, is_merged boolean")
    got = {r.chapter_no: r.html for r in books.rebuilt_chapters(chapters, blocks).collect()}
    assert got[2] == "<p>as it was</p>" and got[1].startswith("<html><body>\n<nav>x</nav><div class='a'><p id=1>first</p><p>second<p>three")


def test_streams_with_state_cache_and_progress(spark, tmp_path):
    schema = "book string, n int, t string"
    source = str(tmp_path / "in")
    told = []
    listener = streams.Progress(lambda total, now: told.append(total))
    spark.streams.addListener(listener)
    try:
        for k, rows in enumerate(([("a", 0, "one"), ("b", 0, "x"), ("a", 1, "two")], [("a", 3, "four"), ("a", 2, "three"), ("b", 1, "y")])):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = streams.rolling_context(streams.read_blocks(spark, source, schema), "book", "n", "t", last=2)
            query = streams.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "point"))
            query.awaitTermination()
            assert streams.cancel(query)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.book, r.ord): r.before for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): [], ("a", 1): ["one"], ("a", 2): ["one", "two"], ("a", 3): ["two", "three"], ("b", 0): [], ("b", 1): ["x"]}
    known = spark.createDataFrame([("k1", "ONE", 1)], "cache_key string, corrected string, stamp int")
    keyed = F.concat(F.lit("k"), (F.col("n") + 1).cast("string"))
    query = streams.write_batches(streams.resumed(streams.read_blocks(spark, source, schema), keyed, known), str(tmp_path / "out2"), str(tmp_path / "point2"))
    query.awaitTermination()
    assert sorted((r.book, r.n, r.cached_text) for r in spark.read.parquet(str(tmp_path / "out2")).collect() if r.cached_text) == [("a", 0, "ONE"), ("b", 0, "ONE")]


def test_names_for_sql(spark):
    registration.register(spark)
    page = "<p>one <b>two</b></p><li>three</li>"
    got = spark.sql(f"SELECT b.* FROM (SELECT '{page}' AS h) p, LATERAL extract_blocks(p.h) b").collect()
    assert [(r.block_no, r.tag, r.text) for r in got] == [(0, "p", "one two"), (1, "li", "three")]
    row = spark.sql("SELECT strip_tags('<b>x</b> &amp;lt;') AS a, decode_entities('&amp;lt;') AS b, count_words(' a\u00a0b\nc ') AS c, count_words(NULL) AS d, text_diff('a b', 'a c').fixed_words AS e").first()
    assert tuple(row) == ("x &amp;lt;", "&lt;", 3, 0, 1)
