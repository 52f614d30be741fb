"""Queries around a run: filters by crop and selection, resets, glossaries, model lists, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions import settings
from bookflow.functions import text as tx
from bookflow.operators import pages, reports
from bookflow.plans.base import BLOCKS, DAMAGED, blocks, damaged, read
from bookflow.plans.page_queries import _ITEMS, items


def crop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = {"top": 0.1, "bottom": 0.05, "left": 0.1, "right": 0.1}
    kept = pages.inside_crop(F.col("y"), F.col("x"), F.col("x") + F.col("width"), F.lit(660.0), F.lit(820.0), crop)
    return items(spark, sf_dir).groupBy("book").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("cut"))


_CROP = f"""
WITH {_ITEMS}, k AS (SELECT book, NOT (y < 820 * 0.1::DOUBLE OR y > 820 * (1 - 0.05::DOUBLE) OR x + width < 660 * 0.1::DOUBLE OR x > 660 * (1 - 0.1::DOUBLE)) AS kept FROM items)
SELECT book, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS cut FROM k GROUP BY book"""


def crop_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that each preset keeps, by book."""
    rows, out = items(spark, sf_dir), []
    kept = {name: F.lit(True) if everything else pages.inside_crop(F.col("y"), F.col("x"), F.col("x") + F.col("width"), F.lit(660.0), F.lit(820.0), {"top": top, "bottom": bottom, "left": 0.0, "right": 0.0}) for name, (top, bottom, everything) in pages.CROP_PRESETS.items()}
    out = [F.struct(F.lit(name).alias("preset"), F.count_if(test).alias("kept")) for name, test in kept.items()]
    return rows.groupBy("book").agg(F.array(*out).alias("of")).select("book", F.inline("of"))


_PRESETS = f"""
WITH {_ITEMS}, p(preset, top, bottom, everything) AS (VALUES ('full', 0.0, 0.0, true), ('novel', 0.05, 0.02, false), ('wide', 0.08, 0.04, false))
SELECT book, preset, count(*) FILTER (everything OR NOT (y < 820 * top::DOUBLE OR y > 820 * (1 - bottom::DOUBLE) OR x + width < 0 OR x > 660)) AS kept FROM items, p GROUP BY ALL"""


def newest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred events, the newest first."""
    return reports.newest_first(read(spark, sf_dir, "events").select("ts", "event_id", "event_type"), "ts", 100).select("event_id", "event_type")


_NEWEST = "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id, event_type LIMIT 100"


def chapter_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source how many documents are chosen, whether all or some are, and the kept titles."""
    chosen = F.col("doc_id") % 3 == 0
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"^([A-Z][a-z]+)\.", 1), F.lit("")), F.concat(F.lit("Bölüm "), (F.col("doc_id") + 1).cast("string")))
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(chosen).alias("selected"), F.bool_and(chosen).alias("all_selected"), F.bool_or(chosen).alias("some_selected"), F.max(title).alias("last_title"))


_SELECTION = """
SELECT source, count(*) FILTER (doc_id % 3 = 0) AS selected, bool_and(doc_id % 3 = 0) AS all_selected, bool_or(doc_id % 3 = 0) AS some_selected,
  max(CASE WHEN regexp_extract(text, '^([A-Z][a-z]+)\\.', 1) <> '' THEN regexp_extract(text, '^([A-Z][a-z]+)\\.', 1) ELSE 'Bölüm ' || (doc_id + 1) END) AS last_title
FROM documents GROUP BY source"""


def reset_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumns({"status": F.lit("completed"), "corrected_text": damaged(F.col("original_text")), "diff_count": F.lit(3)})
    done = settings.reset(rows)
    return done.groupBy("lang", "status").agg(F.count(F.lit(1)).alias("blocks"), F.sum("diff_count").alias("diffs"), F.count_if(F.col("corrected_text") == F.col("original_text")).alias("as_before"))


_RESET = f"WITH {BLOCKS} SELECT lang, 'pending' AS status, count(*) AS blocks, 0::BIGINT AS diffs, count(*) AS as_before FROM blocks GROUP BY lang"


def glossary_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("Muggle"), F.lit("Muggle"), F.lit("tin"), F.lit("kalay"))
    term = F.concat(F.lit(" "), F.split("p_name", " ")[0], F.lit(" "))
    made = settings.glossary_without(settings.glossary_with(base, term, F.col("p_brand")), F.lit("Muggle"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries(made), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("terms"))


_GLOSSARY = "SELECT p_partkey, CASE WHEN trim(string_split(p_name, ' ')[1]) IN ('', 'Muggle') OR trim(p_brand) = '' THEN 'tin=kalay' WHEN string_split(p_name, ' ')[1] = 'tin' THEN 'tin=' || p_brand ELSE array_to_string(list_sort([string_split(p_name, ' ')[1] || '=' || p_brand, 'tin=kalay']), ';') END AS terms FROM part"


def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as models in JSON: those that cost nothing."""
    rows = read(spark, sf_dir, "supplier")
    price = F.when(F.col("s_suppkey") % 4 == 0, "0").otherwise("0.1")
    made = F.to_json(F.struct(F.concat("s_name", F.when(F.col("s_suppkey") % 5 == 0, ":free").otherwise("")).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("context_length"), F.struct(price.alias("prompt"), price.alias("completion")).alias("pricing")))
    fallback = spark.createDataFrame([("none", "none", 0)], "id string, name string, context_length int")
    return settings.free_models(rows.select(F.when(F.col("s_suppkey") % 7 == 0, "no json").otherwise(made).alias("j")), "j", fallback)


_MODELS = "SELECT s_name || CASE WHEN s_suppkey % 5 = 0 THEN ':free' ELSE '' END AS id, s_name AS name, s_nationkey AS context_length FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 4 = 0)"


def progress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: percent done, seconds left and the provider of their address."""
    done = F.col("o_orderkey") % 40
    url = F.element_at(F.array(*[F.lit(u) for u in ("https://openrouter.ai/api", "https://api.groq.com/v1", "http://LOCALHOST:1", "https://x.example")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", settings.progress(done, F.lit(37)).alias("percent"), F.coalesce(settings.seconds_left(done, F.lit(39), F.col("o_custkey")), F.lit(-1)).cast("long").alias("seconds_left"), settings.provider(url).alias("provider"))


_PROGRESS = """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderkey % 40 AS done FROM orders)
SELECT o_orderkey, least(100, floor(done * 100 / 37 + 0.5))::INT AS percent, CASE WHEN done > 0 THEN floor((39 - done) * o_custkey / done + 0.5)::BIGINT ELSE -1 END AS seconds_left,
  ['openrouter', 'groq', 'local', 'custom'][(o_orderkey % 4 + 1)::INT] AS provider FROM r"""


def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    m = settings.book_metadata(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("  "), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.lit(" maker "), F.concat("p_name", F.lit(".PDF")))
    return rows.select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


_METADATA = "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS title, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'maker' END AS creator, 'tr' AS language FROM part"


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as books of their own number of pages, line items as what stands on pages: those of a book's pages that have none."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").cast("int").alias("page"))
    sizes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 9).cast("int").alias("n_pages"))
    return pages.scanned_pages(items, sizes, "book", "page")


_SCANNED = """
SELECT o_orderkey AS book, p.page::INT AS page FROM orders o JOIN (SELECT unnest(range(1, 10)) AS page) p ON p.page <= o.o_custkey % 9
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = p.page)"""


def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row of each damaged block as JSON text, and its clean, escaped form."""
    rows = blocks(spark, sf_dir).withColumn("d", damaged(F.col("original_text"))).filter("d <> original_text")
    out = F.to_json(F.struct(F.lit("regex").alias("source"), F.col("block_no"), F.char_length("d").alias("before"), F.char_length("original_text").alias("after")))
    return rows.select("doc_id", "block_no", out.alias("entry"), F.md5(tx.decode_entities(tx.strip_tags(F.concat(F.lit("<p>"), F.col("d"), F.lit("</p> &amp;lt;"))))).alias("plain_md5"))


_EXPORT = f"""
WITH {BLOCKS} SELECT doc_id, block_no, '{{"source":"regex","block_no":' || block_no || ',"before":' || length({DAMAGED}) || ',"after":' || length(original_text) || '}}' AS entry,
  md5(regexp_replace({DAMAGED}, '<[^>]*>', '', 'g') || ' &lt;') AS plain_md5 FROM blocks WHERE {DAMAGED} <> original_text"""

QUERIES = {
    "crop_filter": crop_filter, "crop_presets": crop_presets, "newest_log": newest_log, "chapter_selection": chapter_selection, "reset_blocks": reset_blocks, "glossary_edit": glossary_edit, "model_catalog": model_catalog,
    "progress_table": progress_table, "book_metadata": book_metadata, "scanned_pages": scanned_pages, "audit_export": audit_export,
}
ORACLES = {
    "crop_filter": _CROP, "crop_presets": _PRESETS, "newest_log": _NEWEST, "chapter_selection": _SELECTION, "reset_blocks": _RESET, "glossary_edit": _GLOSSARY, "model_catalog": _MODELS, "progress_table": _PROGRESS,
    "book_metadata": _METADATA, "scanned_pages": _SCANNED, "audit_export": _EXPORT,
}
