"""Queries over services, the stored cache and word lists, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions.text import turkish_lower
from bookflow.operators import aggregates, batching, cache_table, correct, footnotes, layout, pictures, policy
from bookflow.operators.chains import with_checkpoints
from bookflow.plans.base import BLOCKS, blocks, read
from bookflow.plans.book_queries import page_items
from bookflow.sources import dictionary


class Refused(Exception):
    """What a service answers that won't take a request."""


def _refusing(request: str) -> str:
    if "qu" in request:
        raise Refused("qu")
    return request.replace("the ", "THE ")


def failed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in batches to a model that refuses every request with `qu` in it: by document what was answered, what failed, and the failed lines that kept their text."""
    rows = blocks(spark, sf_dir).select(F.col("doc_id").alias("book"), F.col("block_no").alias("ord"), F.col("original_text").alias("text"))
    done = correct.corrected_or_failed(rows, batching.greedy_batches(rows, "book", "ord", "text", 3000), _refusing, 8)
    both = done.join(rows, ["book", "ord"])
    failed = F.col("source") == "error"
    return both.groupBy("book").agg(F.count_if(~failed).alias("answered"), F.count_if(failed).alias("failed"), F.count_if(failed & F.col("corrected").eqNullSafe(F.col("text")) & (F.col("error") == "Refused: qu")).alias("kept"))


_FAILED = f"WITH {BLOCKS} SELECT doc_id AS book, count(*) FILTER (NOT contains(original_text, 'qu')) AS answered, count(*) FILTER (contains(original_text, 'qu')) AS failed, count(*) FILTER (contains(original_text, 'qu')) AS kept FROM blocks GROUP BY doc_id"


def audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows by where they come from: lines that the rules change, lines that the model answers, lines that it fails on."""
    rows = blocks(spark, sf_dir).select(F.col("doc_id").alias("book"), F.col("block_no").alias("ord"), F.col("original_text").alias("text"))
    done = correct.corrected_or_failed(rows, batching.greedy_batches(rows, "book", "ord", "text", 3000), _refusing, 8)
    rules = rows.filter(F.contains("text", F.lit(" ,"))).select(F.lit("regex").alias("source"))
    return correct.audit_by_source(rules.unionByName(done.select("source")))


_SOURCES = f"""
WITH {BLOCKS}, s AS (SELECT 'regex' AS source FROM blocks WHERE contains(original_text, ' ,') UNION ALL SELECT CASE WHEN contains(original_text, 'qu') THEN 'error' ELSE 'llm' END FROM blocks)
SELECT coalesce(source, 'all') AS source, count(*) AS n FROM s GROUP BY ROLLUP (source)"""


def planned_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as requests of their order, to the services of their ship modes: when each may start."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("batch"), F.element_at(F.array(*map(F.lit, ("gemini", "groq", "fast", "local"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("service"),
        F.when(F.col("l_orderkey") % 2 == 0, "paid").otherwise("free").alias("tier"), (F.col("l_orderkey") % 3 == 0).alias("translates"), (F.col("l_orderkey") % 6).cast("int").alias("asked"),
    )
    allowed = policy.allowed(rows, F.col("asked"), F.col("book") % 4 == 0)
    # what a user asks for holds for all of their requests, so it is part of the service's key
    return policy.planned(allowed, ["service", "tier", "translates", "at_once"], "book", "batch").select("book", "batch", "at_once", "slot", "wave", "start_ms")


_PLANNED = """
WITH r AS (SELECT l_orderkey AS book, l_linenumber AS batch, ['gemini', 'groq', 'fast', 'local'][(l_suppkey % 4 + 1)::INT] AS service, CASE WHEN l_orderkey % 2 = 0 THEN 'paid' ELSE 'free' END AS tier,
    l_orderkey % 3 = 0 AS translates, (l_orderkey % 6)::INT AS asked, l_orderkey % 4 = 0 AS rolls FROM lineitem),
p AS (SELECT *, service IN ('gemini', 'groq') AND tier = 'paid' AS paid FROM r),
a AS (SELECT *, CASE WHEN translates THEN CASE WHEN paid AND NOT rolls THEN 2 ELSE 1 END WHEN paid THEN greatest(1, least(coalesce(nullif(asked, 0), 3), 4))
    WHEN service = 'fast' THEN greatest(1, least(coalesce(nullif(asked, 0), 2), 3)) ELSE 1 END AS at_once,
  CASE WHEN paid THEN CASE WHEN translates THEN 300 ELSE 150 END WHEN service = 'gemini' THEN 3800 WHEN service = 'groq' THEN CASE WHEN translates THEN 2100 ELSE 1200 END
    WHEN service = 'fast' THEN CASE WHEN translates THEN 800 ELSE 400 END ELSE CASE WHEN translates THEN 2000 ELSE 1500 END END AS pause FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY service, tier, translates, at_once ORDER BY book, batch) - 1 AS k FROM a)
SELECT book, batch, at_once::INT AS at_once, (k % at_once)::INT AS slot, k // at_once AS wave, (k // at_once) * pause AS start_ms FROM n"""


def cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one stored cache: orders' clerks go in with their dates, then those of the later half again with other texts; every customer's key is looked up."""
    with_checkpoints(spark)
    name = f"bookflow_cache_{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders")
    key = F.concat(F.lit("k"), (F.col("o_custkey") % 1000).cast("string"))
    run = lambda rows, text: rows.select(key.alias("cache_key"), F.concat(F.lit(text), F.col("o_orderkey").cast("string")).alias("corrected"), F.col("o_orderkey").alias("stamp"))
    cache_table.create(spark, name)
    try:
        cache_table.save(spark, name, run(orders, "one-"))
        cache_table.save(spark, name, run(orders.filter("o_custkey % 5 = 0"), "two-").withColumn("stamp", F.col("stamp") + 1))
        asked = read(spark, sf_dir, "customer").select("c_custkey")
        return cache_table.looked_up(asked, F.concat(F.lit("k"), (F.col("c_custkey") % 1300).cast("string")), name).checkpoint()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_RUNS = """
WITH e AS (SELECT 'k' || (o_custkey % 1000) AS cache_key, 'one-' || o_orderkey AS corrected, o_orderkey AS stamp FROM orders
  UNION ALL SELECT 'k' || (o_custkey % 1000), 'two-' || o_orderkey, o_orderkey + 1 FROM orders WHERE o_custkey % 5 = 0),
l AS (SELECT cache_key, corrected FROM e QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY stamp DESC, corrected DESC) = 1)
SELECT c_custkey, 'k' || (c_custkey % 1300) AS cache_key, corrected AS cached_text FROM customer LEFT JOIN l ON l.cache_key = 'k' || (c_custkey % 1300)"""


def dictionary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a word list built from the benchmark's texts: how many of a document's different words it knows."""
    listed = dictionary.build(read(spark, sf_dir, "benchmark"), "text")
    return dictionary.known(read(spark, sf_dir, "documents"), "doc_id", "text", listed)


_WORDS = "SELECT DISTINCT {key} translate(translate(replace(replace(w, 'İ', 'i'), 'I', 'ı'), 'ABCDEFGHJKLMNOPQRSTUVWXYZÇĞÖŞÜÂÎÛ', 'abcdefghjklmnopqrstuvwxyzçğöşüâîû'), 'âîû', 'aiu') AS word FROM (SELECT {key} unnest(regexp_extract_all(text, '[a-zA-ZçğıöşüÇĞİÖŞÜâîûÂÎÛ]+')) AS w FROM {table}) WHERE length(w) >= 2"
_CHECK = f"""
WITH w AS ({_WORDS.format(key="doc_id,", table="documents")}), d AS ({_WORDS.format(key="", table="benchmark")})
SELECT doc_id, count(*) AS words, count(d.word) AS known FROM w LEFT JOIN d USING (word) GROUP BY doc_id"""


def dictionary_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word list of all documents in Turkish order: each word's place among those of its first letter."""
    return dictionary.in_order(dictionary.build(read(spark, sf_dir, "documents"), "text"))


_SORTED = f"""
WITH d AS ({_WORDS.format(key="", table="documents")})
SELECT word, left(word, 1) AS letter, row_number() OVER (PARTITION BY left(word, 1) ORDER BY translate(word, 'abcçdefgğhıijklmnoöpqrsştuüvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef')) AS place FROM d"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of positioned words, a hash of each page's."""
    lines = layout.page_lines(page_items(spark, sf_dir), layout.partitions(spark))
    texts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("book", "page").agg(F.count(F.lit(1)).alias("lines"), F.md5(F.array_join(F.transform(texts, lambda x: x["text"]), "\n")).alias("texts_md5"))


_LINES = r"""
WITH w AS (SELECT doc_id::VARCHAR AS book, unnest(range(len(p))) AS k, unnest(p) AS t FROM (SELECT doc_id, string_split_regex(text, '\s+') AS p FROM documents)),
s AS (SELECT book, (k // 360 + 1)::INT AS page, k % 360 // 12 AS line, k, replace(replace(replace(t, '*', '[^1]'), '†', '[^1]'), '‡', '[^2]') AS t FROM w WHERE t <> ''),
l AS (SELECT book, page, line, string_agg(t, ' ' ORDER BY k) AS t FROM s GROUP BY ALL UNION ALL SELECT DISTINCT book, page, 1000, page::VARCHAR FROM s)
SELECT book, page, count(*) AS lines, md5(string_agg(t, chr(10) ORDER BY line)) AS texts_md5 FROM l GROUP BY book, page"""

def maintained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four batches, of which the second runs twice: totals by kind from the recorded counts, and the same from the log."""
    with_checkpoints(spark)
    events = read(spark, sf_dir, "events")
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/counts-{uuid.uuid4().hex}"
    before = aggregates.totals(spark, path, ["event_type"], events, F.col("value"))
    for number in (0, 1, 2, 1, 3):
        aggregates.record(path, events.filter(F.col("event_id") % 4 == number), ["event_type"], F.col("value"), number)
    after = aggregates.totals(spark, path, ["event_type"], events, F.col("value"))
    return after.join(before.select("event_type", F.col("n").alias("logged"), F.col("words").alias("logged_words")), "event_type")


_MAINTAINED = """
SELECT event_type, count(*) AS n, sum(floor(least(greatest(coalesce(value, 0), 0), 100000)))::BIGINT AS words, count(*) AS logged, sum(floor(least(greatest(coalesce(value, 0), 0), 100000)))::BIGINT AS logged_words
FROM events GROUP BY event_type"""


def footnote_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an order's paragraphs, each with a mark of its part; suppliers' parts as notes: paragraphs with anchors and notes with links back."""
    rows = read(spark, sf_dir, "lineitem").withColumns({"book": F.col("l_orderkey"), "tag": (F.col("l_partkey") % 5).cast("string")})
    bodies = rows.filter("l_returnflag <> 'A'").select("book", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("pos"), F.concat(F.lit("see[^"), "tag", F.lit("] & [^none]["), "l_returnflag", F.lit("]")).alias("text"))
    notes = rows.groupBy("book", "tag").agg(F.min(F.concat("l_linestatus", F.lit(" <"), F.col("l_linenumber").cast("string"))).alias("note"))
    return footnotes.linked(bodies, notes).select("book", "kind", F.col("ord").cast("int").alias("ord"), "html")


_XHTML = """
WITH r AS (SELECT l_orderkey AS book, l_linenumber AS pos, (l_partkey % 5)::VARCHAR AS tag, l_returnflag AS flag, l_linestatus AS mode, l_partkey AS part, l_suppkey AS supp FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos, part, supp, flag) AS ord, row_number() OVER (PARTITION BY book, tag ORDER BY pos, part, supp, flag) AS k FROM r WHERE flag <> 'A'),
f AS (SELECT book, tag, min(ord) AS first, count(*) AS marks FROM b GROUP BY ALL),
d AS (SELECT book, tag, min(mode || ' <' || pos) AS note FROM r GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY first IS NULL, first, tag) AS number FROM d LEFT JOIN f USING (book, tag))
SELECT book, 'body' AS kind, ord::INT AS ord, '<p>see<a id="ref-' || number || '-' || k || '" href="#note-' || number || '">[' || number || ']</a> &amp; [' || flag || ']</p>' AS html FROM b JOIN n USING (book, tag)
UNION ALL SELECT book, 'note', number::INT, '<aside id="note-' || number || '"><p>' || number || '. ' || replace(note, '<', '&lt;') ||
  coalesce(array_to_string(list_transform(range(1, marks + 1), lambda i: ' <a href="#ref-' || number || '-' || i || '">^</a>'), ''), '') || '</p></aside>' FROM n"""

def book_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bytes as pixels of five kinds, on the pages of books of fifty, with a paragraph and here and there a note on each page: paragraphs, notes, pictures and the bytes of their files."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumns({"book": F.col("doc_id") % 50, "page": F.floor(F.col("doc_id") / 50).cast("int")})
    kind = F.element_at(F.array(*map(F.lit, pictures.KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    made = docs.select("book", "page", F.lit(0).alias("place"), kind.alias("kind"), (F.col("doc_id") % 40 + 10).cast("int").alias("width"), (F.col("doc_id") % 23 + 20).cast("int").alias("height"), F.col("text").cast("binary").alias("data"))
    files = pictures.converted(made)
    body = docs.select("book", "page", F.lit(0).alias("ord"), F.when(F.col("doc_id") % 7 == 0, "note").otherwise("text").alias("kind"), F.lit("x").alias("text"))
    every = pictures.with_pictures(body, files)
    sizes = files.groupBy("book").agg(F.sum(F.octet_length("file")).cast("long").alias("bytes"))
    last = every.groupBy("book").agg(F.count_if((F.col("kind") == "picture") & (F.col("ord") == 1)).alias("after_body"))
    return pictures.book_counts(every).join(last, "book").join(sizes, "book", "left").fillna(0, ["notes", "pictures", "bytes"])


_PICTURES = """
WITH d AS (SELECT doc_id, doc_id % 50 AS book, doc_id % 40 + 10 AS w, doc_id % 23 + 20 AS h FROM documents)
SELECT book, count(*) FILTER (doc_id % 7 = 0) AS notes, count(*) FILTER (w >= 25 AND h >= 25) AS pictures, count(*) FILTER (w >= 25 AND h >= 25) AS after_body,
  coalesce(sum(54 + (3 * w + 3) // 4 * 4 * h) FILTER (w >= 25 AND h >= 25), 0)::BIGINT AS bytes FROM d GROUP BY book"""

QUERIES = {
    "failed_batches": failed_batches, "audit_sources": audit_sources, "planned_calls": planned_calls, "cache_runs": cache_runs, "dictionary_check": dictionary_check, "dictionary_sorted": dictionary_sorted, "page_lines": page_lines,
    "maintained_counts": maintained_counts, "footnote_xhtml": footnote_xhtml, "book_pictures": book_pictures,
}
ORACLES = {"failed_batches": _FAILED, "audit_sources": _SOURCES, "planned_calls": _PLANNED, "cache_runs": _RUNS, "dictionary_check": _CHECK, "dictionary_sorted": _SORTED, "page_lines": _LINES, "maintained_counts": _MAINTAINED, "footnote_xhtml": _XHTML, "book_pictures": _PICTURES}
