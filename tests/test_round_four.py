"""Cases of the fourth review: each failed before."""

import random
from pathlib import Path

import duckdb
import pyarrow.parquet as pq

from bookflow.llm import token_alignment
from bookflow.plans import registry

from test_queries import SF, rows

PARTS = [
    ["a", "-", "ab"],  # texts of one character are blocks in the SQL
    ["&lt;", "x &copy; y", "&nbsp;", "&ampx;", "&amp;lt; &amp &#65;"],  # only four references are read
    ["5 < 6 and a <b", "a > b"],
    ["wide　space", "no break", " ", "a\x0bb", "\x0cform"],  # only ASCII white space is collapsed
]


def test_books_give_the_blocks_of_the_sql_whatever_the_text(spark, tmp_path):
    pages = [(k, "u", f"<html><article class='x'><h1>Title {k}</h1>{''.join(f'<p>{p}</p>' for p in parts)}</article></html>") for k, parts in enumerate(PARTS)]
    pages += [(7, "u", "<html>no article</html>"), (8, "u", None), (9, "u", "<article><p>last</p></article>"), (-3, "u", "<article><p>below 0</p></article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = registry.queries()["epub_round_trip"](spark, str(tmp_path)).toPandas(), con.sql(registry.oracle_sql()["epub_round_trip"]).df()
    assert rows(got) == rows(want) and len(want) == 6


def test_bundles_are_read_a_few_at_a_time(spark):
    some = random.Random(4)
    texts = [" ".join(f"{some.getrandbits(40):x}" for _ in range(100_000)) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bundles, _, rows = token_alignment.align(docs)
    assert bundles.count() == rows.filter("n_groups > 0").count() == 3
    groups = [pq.ParquetFile(f).metadata for f in Path(bundles.scratch_path.removeprefix("file:")).glob("*.parquet")]
    assert sum(g.num_row_groups for g in groups) == 3  # one row group with all of them before


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_gone_through_once(spark):
    assert plan(registry.queries()["page_lines"](spark, SF)).count("Generate posexplode") == 1  # four and more before


def test_notes_are_found_once(spark):
    assert plan(registry.queries()["page_paragraphs"](spark, SF)).count("[dD]ipnot") == 0  # in the steps of the notes, their labels and the body before


def test_pages_of_blank_ends_and_copies_of_items(spark, tmp_path):
    texts = ["", " ", None, "a", " a", "a ", " " + "w " * 360, "w " * 359 + "w", "w " * 360 + "w", "x  y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.queries()["page_lines"](spark, str(tmp_path)).toPandas(), con.sql(registry.oracle_sql()["page_lines"]).df()
    assert rows(got) == rows(want)
