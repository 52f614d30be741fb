"""Queries over the lines of documents, and over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.functions import text as tx
from bookflow.functions.literal_rules import CONFUSED, clean_literal, has_anomaly
from bookflow.operators import answers as answers_of
from bookflow.operators import batching, cache, correct, findings, reports, stitch
from bookflow.operators.chains import kept, with_checkpoints
from bookflow.plans.base import BLOCKS, DAMAGED, blocks, damaged, read, spread

CLEANED_RULES = (1, 4, 13, 53, 54, 55, 56, 89)
COUNTED_RULES = (13, 53, 54, 55, 56, 89)
_L = "a-zA-ZçğıöşüÇĞİÖŞÜ"
_STEPS = ((1, "[\\x{AD}\\x{200B}-\\x{200D}\\x{FEFF}]", ""), (4, f"([{_L}])[·•]([{_L}])", "\\1\\2"), (13, "\\s+([,.!?:;])", "\\1"), (53, "\\.\\s*,+", "."), (54, ",\\s*,+", ","), (55, ":\\s*:+", ":"), (56, ";\\s*;+", ";"), (89, "\\.\\s+\\.\\s+\\.", "..."))


def _sql_cleaned(text: str, numbers: tuple[int, ...] = CLEANED_RULES) -> str:
    for number, pattern, to in _STEPS:
        if number in numbers:
            text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


_ANY = "A-Za-zçÇğĞİöÖşŞüÜ"
_CONS = "bcçdfgğhjklmnprsştvyzBCÇDFGĞHJKLMNPRSŞTVYZ"


def _sql_anomaly(t: str) -> str:
    words = "|".join(CONFUSED)
    tests = (
        "[\\x{FFFD}]", "\\.\\s*,|,\\s*,|::|;;", f"(?i)(^|[^{_L}])({words}|farkıma\\s+var)[A-Za-z0-9_]*($|[^{_L}])", f"[{_L}0-9]+-\\s+[{_L}]+",
        "(?i)cl[aeıioöuü]", "(?i)\\b(bir çok|her hangi|bir az|hiç bir)\\b|bir kaç[A-Za-z0-9_]", "\\s+[,.!?:;]", "\\w+\\s+[''’]\\w+", "\\.\\s+\\.\\s+\\.",
        f"(^|[^{_ANY}])[{_CONS}]{{5,}}($|[^{_ANY}])", "[ÔÊôê@#$\\\\/|<>~]", "\\b[a-zçğıöşü]+[A-ZÇĞİÖŞÜ]+[a-zçğıöşü]+\\b",
    )
    plain = f"regexp_replace({t}, '\\[\\^[a-zA-Z0-9_:-]+\\]:?|\\^[a-zA-Z0-9_:-]+:?', '', 'g')"
    return f"(trim({plain}) <> '' AND ({' OR '.join(f'regexp_matches(trim({plain}), {chr(39)}{p}{chr(39)})' for p in tests)}))"


def clean_literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("d", damaged(F.col("original_text"))).withColumn("c", clean_literal(F.col("d"), CLEANED_RULES))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("d") != F.col("c")).alias("changed"), F.count_if(has_anomaly(F.col("c"), False)).alias("anomalies"),
        F.sum(F.char_length("c")).alias("chars"), F.count_if(F.col("c") == F.col("original_text")).alias("restored"),
    )


def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("d", damaged(F.col("original_text"))).withColumn("before", has_anomaly(F.col("original_text"), False))
    return rows.groupBy("source").agg(
        F.count_if("before").alias("before_damage"), F.count_if(F.when(F.col("d") == F.col("original_text"), F.col("before")).otherwise(has_anomaly(F.col("d"), False))).alias("after_damage"),
        F.count_if(F.col("before") | has_anomaly(F.col("original_text"))).alias("with_split_letters"),
    )


def late_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for apostrophes and stray page numbers, over lines that are given some."""
    rows = blocks(spark, sf_dir)
    return rows.select("doc_id", "block_no", F.md5(clean_literal(F.concat("original_text", F.lit(" don 't. 12 The end! 345. ")), (90, 91, 92))).alias("text_md5"))


_LATE = f"""
WITH {BLOCKS}, a AS (SELECT doc_id, block_no, regexp_replace(original_text || ' don ''t. 12 The end! 345. ', '([{_L}0-9]+)\\s+([''’])([{_L}]+)', '\\1\\2\\3', 'g') AS t FROM blocks),
b AS (SELECT doc_id, block_no, regexp_replace(t, '([.?!:»"''])\\s+[0-9]{{1,4}}\\.?\\s+([A-ZÇĞİÖŞÜ])', '\\1 \\2', 'g') AS t FROM a)
SELECT doc_id, block_no, md5(regexp_replace(t, '([.?!:»"''])\\s+[0-9]{{1,4}}\\.?\\s*$', '\\1')) AS text_md5 FROM b"""
_SPLIT = "regexp_matches(original_text, '(^|[^\\p{L}\\p{N}])\\p{L}{1,2}\\s+\\p{L}{1,2}\\s+\\p{L}{1,2}($|[^\\p{L}\\p{N}])')"


def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("d", damaged(F.col("original_text")))
    return reports.rule_report(reports.rule_changes(rows, ["doc_id"], "d", COUNTED_RULES))


def _sql_rule_report() -> str:
    at, parts, ctes = DAMAGED, [], []
    ctes.append(f"d13 AS (SELECT {at} AS t FROM blocks)")
    names = [s for s in _STEPS if s[0] in COUNTED_RULES]
    for (number, pattern, to), after in zip(names, [*names[1:], None], strict=True):
        parts.append(f"SELECT {number} AS rule_no, before, regexp_replace(before, '{pattern}', '{to}', 'g') AS after FROM (SELECT unnest(regexp_extract_all(t, '{pattern}')) AS before FROM d{number})")
        if after:
            ctes.append(f"d{after[0]} AS (SELECT regexp_replace(t, '{pattern}', '{to}', 'g') AS t FROM d{number})")
    return f"WITH {BLOCKS}, {', '.join(ctes)} SELECT rule_no, before, after, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each rule and of all, in one pass with grouping sets."""
    rows = blocks(spark, sf_dir).withColumn("d", damaged(F.col("original_text")))
    changes = reports.rule_changes(rows, ["lang"], "d", COUNTED_RULES)
    return changes.rollup("lang", "rule_no").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("rule_no", F.lit(0)).alias("rule_no"), "n")


def suspect_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.suspect_words(blocks(spark, sf_dir), ["doc_id", "block_no"], "original_text")


_SUSPECTS = f"""
WITH {BLOCKS}, words AS (
  SELECT doc_id, block_no, original_text, unnest(range(len(w)))::INT AS pos, unnest(w) AS word
  FROM (SELECT *, regexp_extract_all(original_text, '[{_L}0-9]+') AS w FROM blocks)),
low AS (SELECT *, lower(translate(word, 'İI', 'iı')) AS l FROM words),
tagged AS (
  SELECT *, unnest(list_filter([
    CASE WHEN regexp_matches(l, '\\bcl[aeıioöuüa-zçğş]') THEN 'cl as d' END,
    CASE WHEN l IN ('{"','".join(reports.M_FOR_RN)}') OR contains(l,'amlik') OR contains(l,'umuk') OR contains(l,'umdu') OR contains(l,'umca') THEN 'm as rn' END,
    CASE WHEN contains(l,'durna') OR contains(l,'urna') OR contains(l,'irni') THEN 'rn as m' END,
    CASE WHEN regexp_matches(word,'[0-9]') AND regexp_matches(word,'[lhi]') THEN 'digit in word' END,
    CASE WHEN contains(l,'vv') THEN 'vv as w' END,
    CASE WHEN l IN ('{"','".join(reports.UNMARKED)}') THEN 'no marks' END], lambda x: x IS NOT NULL)) AS category FROM low),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category, word ORDER BY doc_id, block_no, pos) AS place FROM tagged)
SELECT category, word, count(*) AS n,
  string_agg(CASE WHEN length(original_text) > 120 THEN left(original_text, 120) || '...' ELSE original_text END, ' | ' ORDER BY place) FILTER (place <= 3) AS contexts
FROM ranked GROUP BY ALL"""

_HEADING = "^[A-Z][^.]{0,40}$"


def stitch_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut again before every ' of ' or ' de ', then stitched."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    cut = F.replace(F.replace(F.col("text"), F.lit(" of "), F.lit("\nof ")), F.lit("ing "), F.lit("ing-\n"))
    rows = docs.select("doc_id", F.posexplode(F.split(cut, "\n")).alias("block_no", "line"))
    out = stitch.stitch_paragraphs(rows, "doc_id", "block_no", "line", tx.trimmed(F.col("line")).rlike(_HEADING.replace("$", r"\z")))
    return out.select(F.col("book").alias("doc_id"), "first", "last", "pieces", F.md5("text").alias("text_md5"), "is_heading")


_STITCH = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(p)))::INT AS ord, trim(unnest(p), E' \\t\\n\\r') AS t
  FROM (SELECT doc_id, string_split(replace(replace(text, ' of ', chr(10) || 'of '), 'ing ', 'ing-' || chr(10)), chr(10)) AS p FROM documents)),
kept AS (SELECT *, regexp_matches(t, '{_HEADING}') AS is_heading FROM lines WHERE t <> '' AND NOT (length(t) <= 2 AND regexp_matches(t, '^[^{_L}0-9]+$')) AND NOT regexp_matches(t, '^[{_L}]\\s*["'']?$')),
pairs AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM kept WHERE NOT is_heading),
flags AS (SELECT *, coalesce(before LIKE '%-', false) AS hyphen, coalesce(before LIKE '%-' OR (NOT regexp_matches(before, '[.?!:»"'']\\s*$') AND regexp_matches(t, '^[a-zçğıöşü]')), false) AS joins FROM pairs),
islands AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island,
    coalesce(lead(joins) OVER (PARTITION BY doc_id ORDER BY ord) AND t LIKE '%-', false) AS cut FROM flags)
SELECT doc_id, min(ord) AS first, max(ord) AS last, count(*) AS pieces,
  md5(string_agg(CASE WHEN joins AND NOT hyphen THEN ' ' ELSE '' END || CASE WHEN cut THEN left(t, length(t) - 1) ELSE t END, '' ORDER BY ord)) AS text_md5, false AS is_heading
FROM islands GROUP BY doc_id, island
UNION ALL SELECT doc_id, ord, ord, 1, md5(t), true FROM kept WHERE is_heading"""


def hyphen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = docs.select("doc_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit(" th"), F.lit("-\nth")), "\n")).alias("block_no", "line"))
    return stitch.merge_hyphen_pairs(rows, "doc_id", "block_no", "line").select(F.col("book").alias("doc_id"), "ord", F.md5("text").alias("text_md5"), "is_merged")


_HYPHENS = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(p)))::INT AS ord, trim(unnest(p), E' \\t\\n\\r') AS t
  FROM (SELECT doc_id, string_split(replace(text, ' th', '-' || chr(10) || 'th'), chr(10)) AS p FROM documents)),
ahead AS (SELECT *, lead(t) OVER b AS after FROM lines WINDOW b AS (PARTITION BY doc_id ORDER BY ord)),
can AS (SELECT *, coalesce(regexp_matches(t, '[{_L}0-9]-$') AND regexp_matches(after, '^[a-zçğıöşü]'), false) AS can FROM ahead),
runs AS (SELECT *, CASE WHEN can AND NOT coalesce(lag(can) OVER (PARTITION BY doc_id ORDER BY ord), false) THEN 1 ELSE 0 END AS starts FROM can),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM runs),
takes AS (SELECT *, can AND row_number() OVER (PARTITION BY doc_id, run, can ORDER BY ord) % 2 = 1 AS takes FROM numbered),
merged AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY ord), false) AS is_merged FROM takes)
SELECT doc_id, ord, md5(CASE WHEN takes THEN left(t, length(t) - 1) || after WHEN is_merged THEN '' ELSE t END) AS text_md5, is_merged FROM merged"""


def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batching.greedy_batches(blocks(spark, sf_dir), "doc_id", "block_no", "original_text", 600)
    return out.select(F.col("book").alias("doc_id"), F.col("ord").alias("block_no"), "batch")


_BATCHES = f"""
WITH RECURSIVE {BLOCKS}, lens AS (SELECT doc_id, block_no, length(original_text) AS n FROM blocks),
fold AS (
  SELECT doc_id, block_no, 0 AS batch, n AS total FROM lens WHERE block_no = 0
  UNION ALL
  SELECT l.doc_id, l.block_no, CASE WHEN f.total > 0 AND f.total + l.n > 600 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.total > 0 AND f.total + l.n > 600 THEN l.n ELSE f.total + l.n END
  FROM fold f JOIN lens l ON l.doc_id = f.doc_id AND l.block_no = f.block_no + 1)
SELECT doc_id, block_no, batch FROM fold"""


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = batching.rolling_context(None, "conv_id", ["turn", "role", "text"], [F.col("role"), F.col("text")])
    rows = _conversations(spark, sf_dir).withColumn("c", context)
    joined = F.array_join(F.transform("c", lambda x: F.concat(x["c0"], F.lit(": "), x["c1"])), "\n")
    return rows.select("conv_id", "turn", F.size("c").alias("n_before"), F.md5(joined).alias("context_md5"))


_ROLLING = """
SELECT conv_id, turn, len(c)::INT AS n_before, md5(array_to_string(c, chr(10))) AS context_md5 FROM (
  SELECT *, coalesce(list(left(role, 300) || ': ' || left(text, 300)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS c FROM conversations)"""


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = batching.rolling_context(None, "conv_id", ["turn", "role", "text"], [F.col("text"), F.col("role")])
    rows = _conversations(spark, sf_dir).withColumn("c", context)
    glossary = F.create_map(F.lit("Muggle"), F.lit("Muggle"))
    content = F.concat(F.lit("[BLOCK_0]"), F.col("text"), F.lit("[/BLOCK_0]"))
    made = batching.prompt(content, F.lit("en"), F.lit("tr"), F.lit("literary"), F.concat(F.lit("Book "), F.col("conv_id").cast("string")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Turn "), F.col("turn").cast("string"))), glossary, F.col("c"))
    return rows.select("conv_id", "turn", F.char_length(made).alias("chars"), F.md5(made).alias("prompt_md5"))


_PROMPT = """
WITH rows AS (SELECT *, list(struct_pack(s := left(text, 300), t := left(role, 300))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM conversations),
made AS (SELECT conv_id, turn, concat_ws(E'\\n\\n',
  E'[TASK]\\nSource: İngilizce\\nTarget: Türkçe\\nStyle: literary',
  concat_ws(E'\\n', '[WORK]', 'Title: Book ' || conv_id, CASE WHEN turn % 2 = 0 THEN 'Chapter: Turn ' || turn END),
  E'[TERMS]\\n- Muggle -> Muggle',
  CASE WHEN len(c) > 0 THEN E'[CONTEXT]\\n' || array_to_string(list_transform(c, lambda x, i: '[Before ' || i || E']\\nSource: ' || x.s || E'\\nText: ' || x.t), E'\\n\\n') END,
  E'[BLOCKS]\\n[BLOCK_0]' || text || '[/BLOCK_0]') AS p FROM rows)
SELECT conv_id, turn, length(p)::INT AS chars, md5(p) AS prompt_md5 FROM made"""


def batch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as one batch response, read back block by block."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    wrapped = F.concat(F.lit("[BLOCK_"), F.col("i").cast("string"), F.lit("]"), F.col("text"), F.lit("[/BLOCK_"), F.col("i").cast("string"), F.lit("]"))
    rows = _conversations(spark, sf_dir).withColumn("i", at)
    responses = rows.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", wrapped.alias("w")))), lambda x: x["w"]), "\n").alias("r"))
    return responses.select("conv_id", F.posexplode(batching.parse_response(F.col("r"), F.col("n"))).alias("idx", "t")).select("conv_id", "idx", F.md5("t").alias("text_md5"))


_PARSE = """
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS idx,
  md5(trim(regexp_replace(text, '\\s{2,}', ' ', 'g'), E' \\t\\n\\r')) AS text_md5 FROM conversations"""


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", tx.cache_key(F.lit("m1"), F.col("original_text"), "tr").alias("cache_key"))


_KEY = """'m1_' || lower(printf('%x', list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split(norm, ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT)), lambda h, c: xor(h * 33, c) & 4294967295))) || '_' || length(norm)"""
_NORM = "trim(regexp_replace(original_text, '\\s+', ' ', 'g'))"
_KEYS = f"WITH {BLOCKS}, n AS (SELECT doc_id, block_no, {_NORM} AS norm FROM blocks) SELECT doc_id, block_no, 'tr_' || {_KEY} AS cache_key FROM n"


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of odd documents are the cache; blocks of the others are looked up."""
    rows = blocks(spark, sf_dir).withColumn("k", tx.cache_key(F.lit("m1"), F.col("original_text")))
    fresh = rows.filter("doc_id % 2 = 1").select(F.col("k").alias("cache_key"), F.upper("original_text").alias("corrected"), F.col("doc_id").alias("stamp"))
    corrections = cache.upserted(fresh.limit(0), fresh)
    found = cache.with_cached(rows.filter("doc_id % 2 = 0").drop("k"), tx.cache_key(F.lit("m1"), F.col("original_text")), corrections)
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("blocks"), F.count("cached_text").alias("hits"))


_HITS = f"""
WITH {BLOCKS}, n AS (SELECT *, {_NORM} AS norm FROM blocks), k AS (SELECT *, {_KEY} AS key FROM n),
c AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 1)
SELECT lang, count(*) AS blocks, count(c.key) AS hits FROM k LEFT JOIN c USING (key) WHERE doc_id % 2 = 0 GROUP BY lang"""


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select(tx.cache_key(F.lit("m1"), F.col("original_text")).alias("cache_key"), F.col("original_text").alias("corrected"), F.col("doc_id").alias("stamp"))
    return cache.stats(cache.upserted(rows.limit(0), rows))


_STATS = f"WITH {BLOCKS}, n AS (SELECT {_NORM} AS norm FROM blocks) SELECT count(DISTINCT {_KEY}) AS entries, floor(count(DISTINCT {_KEY}) * 1.2::DOUBLE + 0.5)::BIGINT AS size_kb FROM n"


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("d", damaged(F.col("original_text"))).withColumn("c", clean_literal(F.col("d"), CLEANED_RULES))
    return rows.select("doc_id", "lang", "block_no", F.col("d").alias("original_text"), F.col("c").alias("corrected_text"), (F.col("block_no") % 5 == 4).alias("is_merged"), F.when(F.col("d") != F.col("c"), 1).otherwise(0).alias("diff_count"))


_CLEANED = f"""{BLOCKS}, cleaned AS (
  SELECT doc_id, lang, block_no, {DAMAGED} AS original_text, {_sql_cleaned(DAMAGED)} AS corrected_text, block_no % 5 = 4 AS is_merged,
    CASE WHEN {DAMAGED} <> {_sql_cleaned(DAMAGED)} THEN 1 ELSE 0 END AS diff_count FROM blocks)"""


def diff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.diff_filter(_cleaned(spark, sf_dir), True, "Ation").select("doc_id", "block_no", F.md5("corrected_text").alias("text_md5"))


_DIFFS = f"WITH {_CLEANED} SELECT doc_id, block_no, md5(corrected_text) AS text_md5 FROM cleaned WHERE NOT is_merged AND diff_count > 0 AND (contains(lower(original_text), 'ation') OR contains(lower(corrected_text), 'ation'))"


def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the literal rules, a row for each block and rule that changed it; those with 'est' in the text or in what they changed."""
    rows = blocks(spark, sf_dir).withColumn("d", damaged(F.col("original_text")))
    changes = reports.rule_changes(rows, ["doc_id", "block_no", "original_text", "d"], "d", COUNTED_RULES)
    log = changes.groupBy("doc_id", "block_no", "rule_no").agg(F.first("original_text").alias("original"), F.first("d").alias("corrected"), F.collect_list(F.struct("before", "after")).alias("changes"))
    log = log.select("doc_id", "block_no", "rule_no", F.lit("regex").alias("source"), F.concat(F.lit("rule "), F.col("rule_no").cast("string")).alias("rule"), "original", "corrected", "changes")
    return reports.audit_filter(log, "regex", "Est").select("doc_id", "block_no", "rule_no", F.size("changes").alias("n_changes"))


def _sql_audit() -> str:
    whole = _sql_rule_report()
    head = whole[: whole.index(" SELECT rule_no, before, after, count(*)")].replace(f"SELECT {DAMAGED} AS t FROM blocks", f"SELECT doc_id, block_no, {DAMAGED} AS t FROM blocks")
    for n in COUNTED_RULES:
        head = head.replace(f"d{n} AS (SELECT regexp", f"d{n} AS (SELECT doc_id, block_no, regexp")
    parts = " UNION ALL ".join(f"SELECT doc_id, block_no, {n} AS rule_no, regexp_extract_all(t, '{p}') AS m FROM d{n}" for n, p, _ in _STEPS if n in COUNTED_RULES)
    return f"{head} SELECT doc_id, block_no, rule_no, len(m)::INT AS n_changes FROM ({parts}) JOIN blocks USING (doc_id, block_no) WHERE len(m) > 0 AND contains(lower(original_text), 'est')"


def chapter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters; blocks that still look damaged aren't done."""
    rows = _cleaned(spark, sf_dir).withColumn("status", F.when(has_anomaly(F.col("corrected_text"), False), "pending").otherwise("completed")).withColumn("is_heading", F.col("corrected_text").rlike(_HEADING.replace("$", r"\z")))
    return reports.chapter_stats(rows.withColumn("original_text", F.col("corrected_text")), ["doc_id"])


_CHAPTERS = f"""
WITH {_CLEANED}, s AS (SELECT *, NOT {_sql_anomaly('corrected_text')} AS done, regexp_matches(corrected_text, '{_HEADING}') AS is_heading FROM cleaned)
SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (done) AS processed_blocks, sum(diff_count)::BIGINT AS fixed_words, bool_and(done) AS complete,
  least(100, floor(count(*) FILTER (done) * 100 / count(*) + 0.5))::BIGINT AS progress,
  CASE WHEN length(min_by(corrected_text, block_no) FILTER (is_heading)) < 75 THEN min_by(corrected_text, block_no) FILTER (is_heading) END AS title
FROM s GROUP BY doc_id"""


def _routed(spark: SparkSession, sf_dir: str, modes: tuple[str, ...]) -> DataFrame:
    """Cleaned lines with a route for each of `modes`. Every eleventh block is a figure, some changed ones are finished already, and documents divisible by 10 are in the cache."""
    rows = _cleaned(spark, sf_dir).withColumn("anomaly", has_anomaly(F.col("corrected_text"), False)).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    figure, finished = F.col("block_no") % 11 == 10, (F.col("block_no") % 7 == 3) & (F.col("diff_count") > 0)
    return rows.withColumn("route", reports.route(F.col("mode"), F.col("anomaly"), F.col("is_merged"), F.col("doc_id") % 10 == 0, F.col("mode") == "translate", figure, finished))


def block_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, ("rules_only", "smart", "deep_llm", "translate")).groupBy("mode", "route").agg(F.count(F.lit(1)).alias("blocks"))


_ROUTE = """CASE WHEN is_merged THEN 'skip' WHEN block_no % 11 = 10 THEN 'figure' WHEN block_no % 7 = 3 AND diff_count > 0 THEN 'kept' WHEN doc_id % 10 = 0 THEN 'cache'
  WHEN mode = 'translate' THEN 'model' WHEN mode = 'rules_only' THEN 'done' WHEN mode = 'deep_llm' THEN 'model' WHEN anomaly THEN 'model' ELSE 'done' END"""
_ROUTES = f"""
WITH {_CLEANED}, a AS (SELECT *, {_sql_anomaly('corrected_text')} AS anomaly, unnest(['rules_only', 'smart', 'deep_llm', 'translate']) AS mode FROM cleaned)
SELECT mode, {_ROUTE} AS route, count(*) AS blocks FROM a GROUP BY ALL"""


def joined_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All routes of the smart mode as one table again: cached texts say so, the model writes OF for of."""
    with_checkpoints(spark)
    routed = kept(_routed(spark, sf_dir, ("smart",)).select("doc_id", "block_no", "route", "original_text", "corrected_text"))  # batches, requests and the join begin with it
    rows = routed.withColumn("cached_text", F.concat(F.lit("cached: "), F.col("original_text")))
    asked = rows.filter("route = 'model'").select(F.col("doc_id").alias("book"), F.col("block_no").alias("ord"), F.col("corrected_text").alias("text"))
    answers = correct.corrected(asked, batching.greedy_batches(asked, "book", "ord", "text", 3000), _writes("OF"), 8)
    out = answers_of.joined_routes(rows, answers.select(F.col("book").alias("doc_id"), F.col("ord").alias("block_no"), "corrected"), ["doc_id", "block_no"])
    return out.select("doc_id", "block_no", "route", F.md5("text").alias("text_md5"))


def _writes(word: str) -> correct.Model:
    return lambda request: request.replace(" of ", f" {word} ")


def sql_answer(text: str) -> str:
    """What the response parser makes of a block: signs of emphasis and a colon at its marks go."""
    inner = f"regexp_replace(regexp_replace({text}, '^\\*{{0,2}}:?', ''), '\\*{{0,2}}$', '')"
    return f"coalesce(nullif(trim(regexp_replace({inner}, '\\s{{2,}}', ' ', 'g'), E' \\t\\n\\r'), ''), corrected_text)"


_JOINED = f"""
WITH {_CLEANED}, a AS (SELECT *, {_sql_anomaly('corrected_text')} AS anomaly, 'smart' AS mode FROM cleaned), r AS (SELECT *, {_ROUTE} AS route FROM a)
SELECT doc_id, block_no, route, md5(CASE route WHEN 'skip' THEN NULL WHEN 'figure' THEN original_text WHEN 'cache' THEN 'cached: ' || original_text
  WHEN 'model' THEN {sql_answer("replace(corrected_text, ' of ', ' OF ')")} ELSE corrected_text END) AS text_md5 FROM r"""


def failing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line asked of a model that fails for requests of odd length, and then of another."""

    def fails(request: str) -> str:
        if len(request) % 2:
            raise ValueError("odd")
        return _writes("OF")(request)

    rows = blocks(spark, sf_dir).select(F.col("doc_id").alias("book"), F.col("block_no").alias("ord"), F.col("original_text").alias("text"))
    done = correct.corrected(rows, rows.select("book", "ord", F.col("ord").alias("batch")), correct.in_turn(fails, _writes("0F")), 8)
    return done.select(F.col("book").alias("doc_id"), F.col("ord").alias("block_no"), F.md5("corrected").alias("text_md5"))


_FAILING = f"""
WITH {BLOCKS}, b AS (SELECT doc_id, block_no, original_text AS corrected_text, replace(original_text, ' of ', CASE WHEN length(original_text) % 2 = 1 THEN ' OF ' ELSE ' 0F ' END) AS t FROM blocks)
SELECT doc_id, block_no, md5({sql_answer('t')}) AS text_md5 FROM b"""


def block_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a model may answer them: in a heading, between marks, in an element that is no block, or bare."""
    line, number = F.col("original_text"), F.col("block_no").cast("string")
    marked = F.concat(F.lit("[BLOCK_"), number, F.lit("]<P>"), line, F.lit(" &amp;lt; more</P>[/BLOCK_"), number, F.lit("]"))
    raw = F.when(F.col("block_no") % 4 == 0, F.concat(F.lit('<h2 class="x">'), line, F.lit("</h2>"))).when(F.col("block_no") % 4 == 1, marked).when(F.col("block_no") % 4 == 2, F.concat(F.lit("<div>"), line, F.lit("</div>"))).otherwise(line)
    rows = blocks(spark, sf_dir).select("doc_id", "block_no", answers_of.block_answer(raw, "li").alias("a"))
    return rows.select("doc_id", "block_no", "a.tag", F.md5("a.inner").alias("inner_md5"), F.md5("a.text").alias("text_md5"))


_ANSWERS = f"""
WITH {BLOCKS}, a AS (SELECT doc_id, block_no, ['h2', 'p', 'li', 'li'][(block_no % 4 + 1)::INT] AS tag,
  trim(CASE block_no % 4 WHEN 1 THEN original_text || ' &amp;lt; more' WHEN 2 THEN '<div>' || original_text || '</div>' ELSE original_text END, E' \t\n\r') AS t FROM blocks)
SELECT doc_id, block_no, tag, md5(t) AS inner_md5,
  md5(trim(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), E' \t\n\r')) AS text_md5 FROM a"""


def first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).withColumn("d", F.replace(damaged(F.col("original_text")), F.lit("ing "), F.lit("ing- ")))
    return findings.first_places(rows, ["doc_id", "block_no"], "d")


def _sql_findings() -> str:
    kinds = {"hyphen split": f"[{_L}]+-\\s+[{_L}]+", "space before punctuation": "\\s+[,.!?:;]"}
    parts = []
    for kind, p in kinds.items():
        each = f"SELECT doc_id, block_no, t, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m FROM d"
        rows = f"SELECT *, unnest(range(1, len(m) + 1)) AS k FROM ({each})"
        at = "(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT"
        found = f"SELECT doc_id, block_no, t, {at} AS pos, m[k] AS match, count(*) OVER () AS n FROM ({rows})"
        shown = "substr(t, greatest(0, pos - 30) + 1, least(length(t), pos + length(match) + 30) - greatest(0, pos - 30))"
        parts.append(f"SELECT '{kind}' AS kind, doc_id, block_no, pos, match, {shown} AS snippet, n FROM (SELECT * FROM ({found}) ORDER BY doc_id, block_no, pos LIMIT 15)")
    return f"WITH {BLOCKS}, d AS (SELECT doc_id, block_no, replace({DAMAGED}, 'ing ', 'ing- ') AS t FROM blocks) " + " UNION ALL ".join(f"({p})" for p in parts)


def completed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.completed_chapters(chapter_stats(spark, sf_dir))


_COMPLETED = f"SELECT count(*) FILTER (complete) AS completed_chapters, count(*) AS chapters FROM ({_CHAPTERS})"


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, and how long reading them takes at four a second."""
    n = tx.word_count(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("words"), tx.duration(n / 4).alias("reading_time"), tx.file_size(F.octet_length("text")).alias("size"), F.md5(tx.escape_xml(F.col("text"))).alias("escaped_md5"))


_WORDS = r"""
WITH w AS (SELECT *, len(regexp_extract_all(text, '\S+'))::BIGINT AS words, strlen(text) AS bytes FROM documents)
SELECT doc_id, words, CASE WHEN words // 4 >= 60 THEN (words // 4 // 60) || ' dk ' || (words // 4 % 60) || ' sn' ELSE (words // 4) || ' sn' END AS reading_time,
  CASE WHEN bytes >= 1048576 THEN printf('%.2f', bytes / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.0f', bytes / 1024.0::DOUBLE) || ' KB' END AS size,
  md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped_md5 FROM w"""


def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list from a corpus: lower-cased, circumflex folded, single words of two letters and more, once each."""
    from bookflow.sources.dictionary import build

    return build(read(spark, sf_dir, "documents"), "text")


_DICTIONARY = f"""
SELECT DISTINCT translate(lower(translate(w, 'İI', 'iı')), 'âîû', 'aiu') AS word
FROM (SELECT unnest(regexp_extract_all(text, '[{_L}âîûÂÎÛ]+')) AS w FROM documents) WHERE length(w) >= 2"""

QUERIES = {
    "clean_literal_rules": clean_literal_rules, "anomaly_counts": anomaly_counts, "rule_report": rule_report, "audit_counts": audit_counts,
    "suspect_words": suspect_words, "stitch_paragraphs": stitch_paragraphs, "hyphen_pairs": hyphen_pairs, "greedy_batches": greedy_batches,
    "rolling_context": rolling_context, "prompt_build": prompt_build, "batch_parse": batch_parse, "cache_keys": cache_keys, "cache_hits": cache_hits,
    "cache_stats": cache_stats, "diff_filter": diff_filter, "audit_filter": audit_filter, "chapter_stats": chapter_stats, "block_routes": block_routes,
    "word_counts": word_counts, "dictionary_build": dictionary_build, "joined_routes": joined_routes, "failing_models": failing_models,
    "block_answers": block_answers, "first_findings": first_findings, "completed_chapters": completed_chapters, "late_rules": late_rules,
}
ORACLES = {
    "clean_literal_rules": f"""WITH {BLOCKS}, c AS (SELECT *, {DAMAGED} AS d, {_sql_cleaned(DAMAGED)} AS c FROM blocks)
        SELECT lang, count(*) AS blocks, count(*) FILTER (d <> c) AS changed, count(*) FILTER ({_sql_anomaly('c')}) AS anomalies,
        sum(length(c))::BIGINT AS chars, count(*) FILTER (c = original_text) AS restored FROM c GROUP BY lang""",
    "anomaly_counts": f"WITH {BLOCKS} SELECT source, count(*) FILTER ({_sql_anomaly('original_text')}) AS before_damage, count(*) FILTER ({_sql_anomaly(DAMAGED)}) AS after_damage, count(*) FILTER ({_sql_anomaly('original_text')} OR {_SPLIT}) AS with_split_letters FROM blocks GROUP BY source",
    "rule_report": _sql_rule_report(),
    "audit_counts": _sql_rule_report().replace(f"SELECT {DAMAGED} AS t FROM", f"SELECT lang, {DAMAGED} AS t FROM").replace("(SELECT regexp_replace(t", "(SELECT lang, regexp_replace(t").replace("AS rule_no, before, regexp_replace(before", "AS rule_no, lang, before, regexp_replace(before").replace("(SELECT unnest(", "(SELECT lang, unnest(").replace("SELECT rule_no, before, after, count(*) AS n FROM", "SELECT coalesce(lang, 'all') AS lang, coalesce(rule_no, 0) AS rule_no, count(*) AS n FROM").replace("GROUP BY ALL", "GROUP BY ROLLUP (lang, rule_no)"),
    "suspect_words": _SUSPECTS, "stitch_paragraphs": _STITCH, "hyphen_pairs": _HYPHENS, "greedy_batches": _BATCHES, "rolling_context": _ROLLING,
    "prompt_build": _PROMPT, "batch_parse": _PARSE, "cache_keys": _KEYS, "cache_hits": _HITS, "cache_stats": _STATS, "diff_filter": _DIFFS,
    "audit_filter": _sql_audit(), "chapter_stats": _CHAPTERS, "block_routes": _ROUTES, "word_counts": _WORDS, "dictionary_build": _DICTIONARY,
    "joined_routes": _JOINED, "failing_models": _FAILING, "block_answers": _ANSWERS, "first_findings": _sql_findings(), "completed_chapters": _COMPLETED, "late_rules": _LATE,
}
