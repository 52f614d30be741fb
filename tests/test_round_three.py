"""Cases of the third review: each failed before."""

import pytest
from pyspark.sql import functions as F

from bookflow.functions import rules
from bookflow.functions import text as tx
from bookflow.operators import batching, correct
from bookflow.sinks import books as sinks
from bookflow.sources import epub


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("n, want", [(512, "0 KB"), (1536, "2 KB"), (2560, "2 KB"), (1179648, "1.12 MB"), (1048576, "1.00 MB")])
def test_halves_of_sizes_go_to_the_even_number(spark, n, want):
    assert value(spark, tx.file_size(F.lit(n))) == want


def test_a_cut_reference_stays_text(spark):
    chapters = spark.createDataFrame([("b", "T", "A", 0, "One", "<p>this &amp; that&amp</p>")], "book string, title string, creator string, chapter_no int, chapter_title string, html string")
    entries = epub.entries(sinks.packaged(chapters).withColumnRenamed("file", "content"))
    assert [r.text for r in epub.blocks(epub.chapters(entries, epub.packages(entries))).collect()] == ["this & that&amp"]


def test_long_responses_are_read_once(spark):
    n = 3000
    response = "\n".join(f"[BLOCK_{k}]text {k}[/BLOCK_{k}]" for k in range(n))
    assert value(spark, batching.parse_response(F.lit(response), F.lit(n))) == [f"text {k}" for k in range(n)]  # took hours before
    assert value(spark, batching.parse_response(F.lit("[BLOCK_99999999999]x[/BLOCK_99999999999]"), F.lit(1))) == [""]  # failed before
    assert value(spark, batching.parse_response(F.lit(None).cast("string"), F.lit(2))) == ["", ""]


def test_no_request_is_asked_twice(spark, tmp_path):
    rows = spark.createDataFrame([("b", k, "bad" if k == 2 else f"text {k}") for k in range(4)], "book string, ord int, text string")

    def model(request):
        with open(tmp_path / "calls", "a") as out:
            out.write(request.replace("\n", " ") + "\n")
        if "bad" in request:
            raise ValueError("no")
        return request

    done = correct.corrected_or_failed(rows, rows.select("book", "ord", F.lit(0).alias("batch")), model, 1)
    assert sorted((r.ord, r.source) for r in done.collect()) == [(0, "llm"), (1, "llm"), (2, "error"), (3, "llm")]
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == len(set(calls)) == 5  # the checkpoint asked each twice before


def test_rules_that_can_find_nothing_are_not_tried():
    tried = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def sub(self, to, text):
            tried.append(text)
            return self.pattern.sub(to, text)

    lexicon = rules.Lexicon([])
    every = [(n, name, Counted(p), to) for n, name, p, to in rules.catalog(lexicon)]
    assert rules.repair("plain words alone", every, lexicon) == ("plain words alone", [])
    assert len(tried) < 10  # all 92 before
    assert rules.repair("YARM deil soma B a ş l a d ı de ğil", every, lexicon)[0] == "YARIN değil sonra Başladı değil"
