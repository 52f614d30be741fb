"""Queries over pages, and over the order tables read as books: a supplier's line items are the items of a book, their line number the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions import text as tx
from bookflow.operators import footnotes, pages, reports
from bookflow.plans.base import BLOCKS, blocks, read
from bookflow.sources import html_blocks

_ITEMS = """items AS (
  SELECT l_suppkey AS book, l_linenumber AS page, l_orderkey AS item, l_partkey AS part, (l_partkey * 7 % 600)::DOUBLE AS x, (l_orderkey * 13 % 800)::DOUBLE AS y,
    l_quantity AS width, (l_partkey % 12 + 8)::DOUBLE AS font, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("part"),
        (F.col("l_partkey") * 7 % 600).cast("double").alias("x"), (F.col("l_orderkey") * 13 % 800).cast("double").alias("y"), F.col("l_quantity").alias("width"),
        (F.col("l_partkey") % 12 + 8).cast("double").alias("font"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


def html_blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.blocks_by_pattern(read(spark, sf_dir, "pages"), ["page_id"], "html")
    return out.select("page_id", "block_no", "tag", F.md5("text").alias("text_md5"))


def _sql_text(x: str) -> str:
    return f"trim(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), E' \\t\\n\\r' || chr(160))"


_TAGS = "p|h1|h2|h3|h4|h5|h6|li|blockquote"
_HTML = f"""
WITH found AS (SELECT page_id, unnest(range(len(w))) AS place, unnest(w) AS w FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(?:{_TAGS})[^>]*>.*?</(?:{_TAGS})>') AS w FROM pages)),
texts AS (SELECT page_id, place, lower(regexp_extract(w, '(?i)<({_TAGS})', 1)) AS tag, {_sql_text('w')} AS t FROM found)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS block_no, tag, md5(t) AS text_md5 FROM texts WHERE t <> ''"""


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    count = lambda p: F.regexp_count(html, F.lit(p))
    return read(spark, sf_dir, "pages").select("page_id", html_blocks.page_title(html).alias("title"), count("(?i)<h[1-6][^>]*>").alias("headings"), count("(?i)<p[^>]*>").alias("paragraphs"))


_TITLES = f"""
SELECT page_id, regexp_replace({_sql_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g') AS title,
  len(regexp_extract_all(html, '(?i)<h[1-6][^>]*>'))::INT AS headings, len(regexp_extract_all(html, '(?i)<p[^>]*>'))::INT AS paragraphs FROM pages"""


def html_tree_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.blocks_by_tree(read(spark, sf_dir, "pages"), "page_id", "html")


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.page_boxes(items(spark, sf_dir), ["book", "page"], "x", "y", "width", F.lit(660.0), F.lit(820.0))
    return out.withColumn("entered", pages.clamp_crop(F.col("crop_left") * 3))


_BOX = f"""
WITH {_ITEMS}, box AS (SELECT book, page, count(*) AS n_items, min(x) AS "left", max(x + width) AS "right", min(y) AS top, max(y) AS bottom FROM items GROUP BY ALL),
crop AS (SELECT *, floor(least(greatest("left" / 660.0::DOUBLE, 0), 0.25) * 100) / 100 AS crop_left, floor(least(greatest(1 - "right" / 660.0::DOUBLE, 0), 0.25) * 100) / 100 AS crop_right,
  floor(least(greatest(top / 820.0::DOUBLE, 0), 0.25) * 100) / 100 AS crop_top, floor(least(greatest(1 - bottom / 820.0::DOUBLE, 0), 0.25) * 100) / 100 AS crop_bottom FROM box)
SELECT *, floor(least(greatest(crop_left * 3, 0), 0.35) * 100 + 0.5) / 100 AS entered FROM crop"""


def representative_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = items(spark, sf_dir).groupBy("book", "page").agg(F.count(F.lit(1)).alias("n_items"))
    return pages.representative_pages(counted, "book", "page", "n_items")


_REPRESENTATIVE = f"""
WITH {_ITEMS}, c AS (SELECT book, page, count(*) AS n FROM items GROUP BY ALL), s AS (SELECT book, max(page) AS m FROM c GROUP BY book),
few AS (SELECT DISTINCT book, unnest(list_concat([greatest(1, floor(m * 0.2::DOUBLE + 0.5)), greatest(1, floor(m * 0.35::DOUBLE + 0.5)), greatest(1, floor(m * 0.5::DOUBLE + 0.5)), greatest(1, floor(m * 0.65::DOUBLE + 0.5)),
  greatest(1, floor(m * 0.8::DOUBLE + 0.5)), 1], CASE WHEN m >= 10 THEN [5, 10] WHEN m >= 5 THEN [5] ELSE [] END))::INT AS page FROM s),
r AS (SELECT c.book, c.page, row_number() OVER (PARTITION BY c.book ORDER BY n DESC, c.page) AS place FROM c JOIN few USING (book, page))
SELECT book, page FROM r WHERE place = 1"""


def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.running_medians(items(spark, sf_dir), "book", "page", "font")


_MEDIAN = f"""
WITH {_ITEMS}, p AS (SELECT DISTINCT book, page FROM items),
l AS (SELECT p.book, p.page, list_sort(list(i.font)) AS f FROM p JOIN items i ON i.book = p.book AND i.page <= p.page GROUP BY ALL)
SELECT book, page, f[len(f) // 2 + 1] AS median FROM l"""


def line_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = items(spark, sf_dir).groupBy("book", "page").agg(F.collect_list("x").alias("xs"))
    return out.select("book", "page", pages.percentile(F.col("xs"), 0.15).alias("p15"), pages.percentile(F.col("xs"), 0.85).alias("p85"))


_MARGINS = f"WITH {_ITEMS}, l AS (SELECT book, page, list_sort(list(x)) AS xs FROM items GROUP BY ALL) SELECT book, page, xs[floor(len(xs) * 0.15::DOUBLE)::INT + 1] AS p15, xs[floor(len(xs) * 0.85::DOUBLE)::INT + 1] AS p85 FROM l"


def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and names as lines: which are running heads, feet or page numbers."""
    line = F.when(F.col("part") % 3 == 0, F.col("page").cast("string")).when(F.col("part") % 3 == 1, F.concat(F.lit("Sayfa "), F.col("page").cast("string"))).otherwise(F.concat(F.lit("Line of text "), F.col("item").cast("string"), F.lit(".")))
    drop = pages.is_header_or_footer(line, F.col("y"), F.col("font"), F.lit(820.0), F.lit(12.0), F.col("page"), 0.08, 0.04)
    return items(spark, sf_dir).groupBy("book", "page").agg(F.count_if(drop).alias("dropped"), F.count_if(~drop).alias("kept"))


_HEADERS = f"""
WITH {_ITEMS}, t AS (SELECT *, CASE WHEN part % 3 = 0 THEN page::VARCHAR WHEN part % 3 = 1 THEN 'Sayfa ' || page ELSE 'Line of text ' || item || '.' END AS t FROM items),
d AS (SELECT *, ((y <= 820 * 0.08::DOUBLE OR y >= 820 * (1 - 0.04::DOUBLE)) AND part % 3 <> 2) OR (font <= 12 * 1.15::DOUBLE AND part % 3 = 0 AND (y <= 82 OR y >= 820 * 0.9::DOUBLE)) AS drop_it FROM t)
SELECT book, page, count(*) FILTER (drop_it) AS dropped, count(*) FILTER (NOT drop_it) AS kept FROM d GROUP BY ALL"""


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.split_lines(items(spark, sf_dir), ["book", "page"], ["x", "item", "part", "width"], "x", "width", 10)
    return rows.groupBy("book", "page", "segment").agg(F.count(F.lit(1)).alias("n_items"), F.min("x").alias("min_x"), F.max(F.col("x") + F.col("width")).alias("max_x"))


_SEGMENTS = f"""
WITH {_ITEMS}, c AS (SELECT *, CASE WHEN x - lag(x + width) OVER b > 10 THEN 1 ELSE 0 END AS cut FROM items WINDOW b AS (PARTITION BY book, page ORDER BY x, item, part, width)),
s AS (SELECT *, (sum(cut) OVER (PARTITION BY book, page ORDER BY x, item, part, width ROWS UNBOUNDED PRECEDING))::INT AS segment FROM c)
SELECT book, page, segment, count(*) AS n_items, min(x) AS min_x, max(x + width) AS max_x FROM s GROUP BY ALL"""


def superscript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    marks = rows.filter("flag = 'R'").groupBy("book", "page", F.col("item").alias("mark")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    lines = rows.filter("flag = 'N'").groupBy("book", "page", F.col("item").alias("line")).agg(F.min("x").alias("min_x"), F.max(F.col("x") + 200).alias("max_x"), F.min("y").alias("line_y"))
    return pages.nearest_lines(marks, lines, ["book", "page"])


_SUPERSCRIPTS = f"""
WITH {_ITEMS}, m AS (SELECT book, page, item AS mark, min(x) AS x, min(y) AS y FROM items WHERE flag = 'R' GROUP BY ALL),
l AS (SELECT book, page, item AS line, min(x) AS min_x, max(x + 200) AS max_x, min(y) AS line_y FROM items WHERE flag = 'N' GROUP BY ALL),
r AS (SELECT book, page, mark, line, abs(y - line_y) AS away, row_number() OVER (PARTITION BY book, page, mark ORDER BY abs(y - line_y), line) AS place
  FROM m JOIN l USING (book, page) WHERE abs(y - line_y) <= 8.5 AND x >= min_x - 15 AND x <= max_x + 25)
SELECT book, page, mark, line, away FROM r WHERE place = 1"""


def first_last_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = W.partitionBy("book", "page").orderBy("y", "x", "item", "part", "width"), W.partitionBy("book", "page").orderBy(F.desc("y"), F.desc("x"), F.desc("item"), F.desc("part"), F.desc("width"))
    rows = items(spark, sf_dir).withColumn("from_top", F.row_number().over(up)).withColumn("from_bottom", F.row_number().over(down))
    return rows.filter("from_top <= 5 OR from_bottom <= 5").select("book", "page", "item", "part", "from_top", "from_bottom")


_FIRST_LAST = f"""
WITH {_ITEMS}, r AS (SELECT book, page, item, part, row_number() OVER (PARTITION BY book, page ORDER BY y, x, item, part, width)::INT AS from_top,
  row_number() OVER (PARTITION BY book, page ORDER BY y DESC, x DESC, item DESC, part DESC, width DESC)::INT AS from_bottom FROM items)
SELECT * FROM r WHERE from_top <= 5 OR from_bottom <= 5"""


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = items(spark, sf_dir).withColumn("tag", F.col("part") % 97).withColumn("pos", F.struct("page", "item", "part", "width"))
    references = rows.filter("flag = 'R' AND tag < 60").select("book", "tag", "pos")
    definitions = rows.filter("flag = 'A'").select("book", "tag", "pos", "page", F.concat("status", F.col("item").cast("string")).alias("note"))
    ranges = [F.struct(F.lit(k).alias("chapter"), F.lit(a).alias("start_page"), F.lit(b).alias("end_page")) for k, a, b in ((1, 1, 3), (2, 3, 5), (3, 5, 7))]
    chapters = rows.select("book").distinct().select("book", F.inline(F.array(*ranges)))
    return references, definitions, chapters


_NOTES = f"""{_ITEMS}, notes AS (SELECT *, part % 97 AS tag FROM items), refs AS (SELECT * FROM notes WHERE flag = 'R' AND tag < 60),
defs AS (SELECT book, tag, page, status || item AS note, row_number() OVER (PARTITION BY book, tag ORDER BY page DESC, item DESC, part DESC, width DESC) AS place FROM notes WHERE flag = 'A'),
last AS (SELECT book, tag, page, note FROM defs WHERE place = 1)"""


def footnote_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    references, definitions, _ = _notes(spark, sf_dir)
    return footnotes.numbered(references, definitions)


_NUMBERS = f"""
WITH {_NOTES}, f AS (SELECT book, tag, row_number() OVER (PARTITION BY book, tag ORDER BY page, item, part, width) AS k, page, item, part, width FROM refs),
n AS (SELECT book, tag, row_number() OVER (PARTITION BY book ORDER BY page, item, part, width, tag)::INT AS number FROM f WHERE k = 1)
SELECT book, tag, number, note FROM n LEFT JOIN last USING (book, tag)"""


def footnote_definitions_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    references, definitions, _ = _notes(spark, sf_dir)
    return footnotes.numbered_by_definition(references, definitions)


_BY_DEFINITION = f"""
WITH {_NOTES}, alld AS (SELECT book, tag, page, item, part, width, status || item AS note, row_number() OVER (PARTITION BY book, tag ORDER BY page, item, part, width) AS k FROM notes WHERE flag = 'A'),
firstref AS (SELECT *, row_number() OVER (PARTITION BY book, tag ORDER BY page, item, part, width) AS k FROM refs),
every AS (SELECT book, tag, page, item, part, width, note, 0 AS late FROM alld WHERE k = 1
  UNION ALL SELECT r.book, r.tag, r.page, r.item, r.part, r.width, '', 1 FROM firstref r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM alld a WHERE a.book = r.book AND a.tag = r.tag))
SELECT book, tag, row_number() OVER (PARTITION BY book ORDER BY late, page, item, part, width, tag)::INT AS number, note FROM every"""


def footnote_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footnotes.orphans(*_notes(spark, sf_dir))


_ORPHANS = f"""
WITH {_NOTES}, c(chapter, a, b) AS (VALUES (1, 1, 3), (2, 3, 5), (3, 5, 7))
SELECT book, tag, note, min(chapter)::INT AS chapter FROM last ANTI JOIN refs USING (book, tag) JOIN c ON page BETWEEN a AND b GROUP BY ALL"""


def footnote_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    references, definitions, _ = _notes(spark, sf_dir)
    numbers = footnotes.numbered(references, definitions)
    bodies = items(spark, sf_dir).select("book", "page", "item", "part", "width", F.concat(F.lit("see[^"), (F.col("part") % 97).cast("string"), F.lit("] and [^none].")).alias("text"))
    return footnotes.resolve(bodies.distinct(), numbers, ["book", "page", "item", "part", "width"], "text").drop("book")


_RESOLVE = f"""
WITH {_NOTES}, f AS (SELECT book, tag, row_number() OVER (PARTITION BY book, tag ORDER BY page, item, part, width) AS k, page, item, part, width FROM refs),
n AS (SELECT book, tag, row_number() OVER (PARTITION BY book ORDER BY page, item, part, width, tag) AS number FROM f WHERE k = 1),
b AS (SELECT DISTINCT book, page, item, part, width, part % 97 AS tag FROM items)
SELECT page, item, part, width, 'see' || coalesce('[' || number || ']', '') || ' and .' AS text FROM b LEFT JOIN n USING (book, tag)"""


def spine_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a customer's spine; the manifest is the line items, the last of an id wins; items without entry drop out."""
    spine = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("idref"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos"))
    manifest = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("m")).select("id", F.concat(F.lit("text/"), tx.chapter_href(F.col("m.l_partkey"))).alias("href"))
    return spine.join(manifest, spine.idref == manifest.id).select("book", "pos", "idref", "href")


_SPINE = """
WITH s AS (SELECT o_custkey AS book, o_orderkey AS idref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS pos FROM orders),
m AS (SELECT l_orderkey AS id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem)
SELECT book, pos, idref, 'text/chapter_' || CASE WHEN length(l_partkey::VARCHAR) >= 3 THEN left(l_partkey::VARCHAR, 3) ELSE lpad(l_partkey::VARCHAR, 3, '0') END || '.xhtml' AS href FROM s JOIN m ON idref = id AND k = 1"""


def global_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "convert").when(F.col("event_type") == "click", "translate").otherwise("other")
    return reports.global_counters(read(spark, sf_dir, "events"), action, F.col("value") * 1000)


_COUNTERS = """
SELECT count(*) FILTER (event_type = 'view') AS converted, count(*) FILTER (event_type = 'click') AS translated,
  coalesce(sum(floor(least(greatest(value * 1000, 0), 100000))) FILTER (event_type IN ('view', 'click')), 0)::BIGINT AS words FROM events"""


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with a fallback: the number in `k`, 0 where there is none."""
    number = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(number.cast("long")).alias("total"))


_PROPS = "SELECT event_type, count(*) AS n, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)::BIGINT)::BIGINT AS total FROM events GROUP BY event_type"


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with dot leaders to a page added: the first line that points at each page."""
    rows = blocks(spark, sf_dir).withColumn("line", F.when(F.col("block_no") % 3 == 0, F.concat(F.lit("Title ..... "), (F.col("block_no") * 7 + F.col("doc_id") % 50).cast("string"))).otherwise(F.regexp_replace("original_text", r"[.0-9]", "")))
    return pages.table_of_contents(rows, "doc_id", "block_no", "line")


_CONTENTS = f"""
WITH {BLOCKS}, l AS (SELECT doc_id, block_no, block_no * 7 + doc_id % 50 AS target FROM blocks WHERE block_no % 3 = 0)
SELECT doc_id, target::INT AS target, min(greatest(block_no - 5, 0))::INT AS first FROM l WHERE target BETWEEN 10 AND 999 GROUP BY ALL"""


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.element_at(F.array(F.lit(".pdf"), F.lit(".epub"), F.lit(".mobi")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", tx.parser_of(name).alias("parser"), tx.output_name(name).alias("repaired"), tx.output_name(name, F.lit("tr")).alias("translated"))


_NAMES = """
SELECT p_partkey, ['pdf', 'epub', 'mobi'][(p_partkey % 3 + 1)::INT] AS parser, p_name || '_duzeltilmis' AS repaired, p_name || '_tr_cevrilmis' AS translated FROM part"""

QUERIES = {
    "html_blocks": html_blocks_query, "html_titles": html_titles, "html_tree_blocks": html_tree_blocks, "page_boxes": page_boxes, "representative_page": representative_page,
    "running_median": running_median, "line_margins": line_margins, "header_footer": header_footer, "line_segments": line_segments, "superscript_lines": superscript_lines,
    "first_last_items": first_last_items, "footnote_numbers": footnote_numbers, "footnote_orphans": footnote_orphans, "footnote_resolve": footnote_resolve, "footnote_definitions_first": footnote_definitions_first,
    "spine_manifest": spine_manifest, "global_counters": global_counters, "event_props": event_props, "contents_pages": contents_pages, "output_names": output_names,
}
ORACLES = {
    "html_blocks": _HTML, "html_titles": _TITLES, "page_boxes": _BOX, "representative_page": _REPRESENTATIVE, "running_median": _MEDIAN, "line_margins": _MARGINS,
    "header_footer": _HEADERS, "line_segments": _SEGMENTS, "superscript_lines": _SUPERSCRIPTS, "first_last_items": _FIRST_LAST, "footnote_numbers": _NUMBERS,
    "footnote_orphans": _ORPHANS, "footnote_resolve": _RESOLVE, "footnote_definitions_first": _BY_DEFINITION, "spine_manifest": _SPINE, "global_counters": _COUNTERS, "event_props": _PROPS, "contents_pages": _CONTENTS,
    "output_names": _NAMES,
}
