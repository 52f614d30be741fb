"""Small projections around a run: model lists, providers, glossaries, metadata, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import round_half_up, trimmed

MODEL = "struct<id:string,name:string,context_length:int,pricing:struct<prompt:string,completion:string>>"
# Parts of a base URL and the provider that each stands for, the first that fits.
PROVIDERS = (("openrouter.ai", "openrouter"), ("generativelanguage", "gemini"), ("groq.com", "groq"), ("openai.com", "openai"), ("localhost", "local"))


def free_models(rows: DataFrame, json: str, fallback: DataFrame) -> DataFrame:
    """`id, name, context_length` of the models that cost nothing, from rows of JSON; `fallback` where there is none. Rows that aren't JSON are skipped."""
    model = rows.select(F.from_json(json, MODEL).alias("m")).filter("m.id IS NOT NULL").select("m.*")
    free = model.filter(F.col("id").endswith(":free") | (F.col("pricing.prompt") == "0") & (F.col("pricing.completion") == "0")).select("id", "name", "context_length")
    return free.unionByName(fallback.filter(F.lit(True)).join(free.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def provider(url: Column) -> Column:
    out = F.lit("custom")
    for part, name in reversed(PROVIDERS):
        out = F.when(F.contains(F.lower(url), F.lit(part)), name).otherwise(out)
    return out


def provider_ready(name: Column, key: Column, signed_in: Column) -> Column:
    """Whether a provider can be called: a local one always, a signed-in one with its token, others with a key."""
    return F.when(name == "local", True).when(name == "proxy", F.coalesce(signed_in, F.lit(False))).otherwise(F.coalesce(trimmed(key) != "", F.lit(False)))


def glossary_with(glossary: Column, term: Column, translation: Column) -> Column:
    """`glossary` with a trimmed entry added or replaced; as it was where either is blank."""
    t, v = trimmed(term), trimmed(translation)
    return F.when((t != "") & (v != ""), F.map_concat(F.map_filter(glossary, lambda k, _: k != t), F.create_map(t, v))).otherwise(glossary)


def glossary_without(glossary: Column, term: Column) -> Column:
    return F.map_filter(glossary, lambda k, _: k != trimmed(term))


def book_metadata(title: Column, author: Column, creator: Column, file_name: Column) -> Column:
    """Title (the file's name where there is none), author or creator, and language of a PDF."""
    some = lambda c: F.nullif(trimmed(c), F.lit(""))
    return F.struct(F.coalesce(some(title), F.regexp_replace(file_name, r"(?i)\.pdf\z", "")).alias("title"), F.coalesce(some(author), some(creator)).alias("creator"), F.lit("tr").alias("language"))


def reset(blocks: DataFrame) -> DataFrame:
    """All blocks as they were before the first run."""
    return blocks.withColumns({"status": F.lit("pending"), "corrected_text": F.col("original_text"), "diff_count": F.lit(0)})


def progress(done: Column, total: Column) -> Column:
    """Percent from 0 to 100, halves up; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), round_half_up(done * 100 / total))).otherwise(0).cast("int")


def seconds_left(done: Column, total: Column, elapsed: Column) -> Column:
    """What is left at the pace so far; null before the first is done."""
    return F.when(done > 0, round_half_up((total - done) * elapsed / done)).cast("long")
