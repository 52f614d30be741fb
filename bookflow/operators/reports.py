"""Counts and filters over blocks and the log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.literal_rules import LITERAL_RULES
from bookflow.functions.text import LETTERS, turkish_lower
from bookflow.operators.chains import kept, with_checkpoints


def _change(pattern: str, to: str):
    return lambda match: F.struct(match.alias("before"), F.regexp_replace(match, pattern, to).alias("after"))


def rule_changes(blocks: DataFrame, keys: list[str], text: str, numbers: tuple[int, ...]) -> DataFrame:
    """`keys, rule_no, before, after`: each match of each literal rule, in the text that the rules before left."""
    rows, steps, at = blocks.withColumn("_t0", F.col(text)), [], 0
    for number, pattern, to in LITERAL_RULES:
        if number in numbers:
            found = F.regexp_extract_all(F.col(f"_t{at}"), F.lit(f"({pattern})"), 1)
            steps.append(F.struct(F.lit(number).alias("rule_no"), F.transform(found, _change(pattern, to)).alias("changes")))
            rows, at = rows.withColumn(f"_t{at + 1}", F.regexp_replace(f"_t{at}", pattern, to)), at + 1  # a column of its own, so each is made once
    each = rows.select(*keys, F.explode(F.array(*steps)).alias("s")).select(*keys, "s.rule_no", F.explode("s.changes").alias("c"))
    return each.select(*keys, "rule_no", "c.before", "c.after")


def rule_report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("rule_no", "before", "after").agg(F.count(F.lit(1)).alias("n"))


# Words that lack their marks, and words that hold a known confusion.
UNMARKED = "soz cocuk guzel bugun degil hic bircok herhangi birkac biraz hicbir nasil neden nicin oldu oluyor geliyor geldi gitti biliyor".split()
M_FOR_RN = "yarm kamı öğmeci somaki soma farkıma davram tuma koma imsan ayrımlı yalmız yamlış düşümce korkumç görüm bumu karamlık öğme kame modem".split()


def suspect_categories(word: Column) -> Column:
    """The kinds of damage that a word may have; a word can have several."""
    low = turkish_lower(word)
    tests = {
        "cl as d": low.rlike("(?<![A-Za-z0-9_])cl[aeıioöuüa-zçğş]"),
        "m as rn": low.isin(*M_FOR_RN) | low.contains("amlik") | low.contains("umuk") | low.contains("umdu") | low.contains("umca"),
        "rn as m": low.contains("durna") | low.contains("urna") | low.contains("irni"),
        "digit in word": word.rlike("[0-9]") & word.rlike("[lhi]"),
        "vv as w": low.contains("vv"),
        "no marks": low.isin(*UNMARKED),
    }
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda c: c.isNotNull())


def _any_case(word: str) -> str:
    """A pattern of what turkish_lower makes `word` of."""
    return "".join(f"[{c}{ {'i': 'İ', 'ı': 'I'}.get(c, c.upper()) }]" for c in word)


def _one_of(words: list[str]) -> str:
    """A pattern of any of `words` in any case, tried by their first letters."""
    heads = {w[0]: sorted({v[1:] for v in words if v[0] == w[0]}) for w in words}
    return "|".join(f"{_any_case(head)}(?:{'|'.join(map(_any_case, tails))})" for head, tails in heads.items())


_OTHER = "a-gj-km-zçğıöşüA-ZÇĞİÖŞÜ"  # letters but l, h and i
#: What every word of some category has in it, where a word is all letters and digits that stand together.
SUSPECT = (
    f"[cC][lL][{LETTERS}]|{_one_of(['amlik', 'umuk', 'umdu', 'umca', 'urna', 'irni', 'vv'])}|[0-9][{_OTHER}]*+[lhi]|[lhi][{_OTHER}]*+[0-9]"
    f"|(?<![{LETTERS}0-9])(?:{_one_of(M_FOR_RN + UNMARKED)})(?![{LETTERS}0-9])"
)


def suspect_words(blocks: DataFrame, order: list[str], text: str, contexts: int = 3, chars: int = 120) -> DataFrame:
    """`category, word, n, contexts`: how often, and where first.

    Only blocks in which one pattern finds a suspect become words, and only
    suspects are sorted into categories. They are few, and written once.
    """
    with_checkpoints(blocks.sparkSession)
    some = blocks.filter(F.col(text).rlike(SUSPECT))
    words = some.select(*order, text, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}0-9]+)"), 1)).alias("pos", "word")).filter(F.col("word").rlike(SUSPECT))
    shown = F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(F.col(text))
    found = kept(words.select(*order, "pos", "word", shown.alias("shown"), F.explode(suspect_categories(F.col("word"))).alias("category")))
    first = W.partitionBy("category", "word").orderBy(*order, "pos")
    top = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= contexts)
    top = top.groupBy("category", "word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "shown"))), lambda p: p["shown"]), " | ").alias("contexts"))
    return found.groupBy("category", "word").agg(F.count(F.lit(1)).alias("n")).join(top, ["category", "word"])


def audit_filter(log: DataFrame, source: str | None, needle: str) -> DataFrame:
    """Log rows of a source (all for None) with `needle`, in any case, in a name, a text or one of the changes."""
    low = needle.lower()
    hit = lambda c: F.lower(c).contains(low)
    where = hit(F.col("rule")) | hit(F.col("original")) | hit(F.col("corrected")) | F.exists("changes", lambda c: hit(c["before"]) | hit(c["after"]))
    return log.filter(where if source is None else where & (F.col("source") == source))


def diff_filter(blocks: DataFrame, only_changed: bool, needle: str = "") -> DataFrame:
    """Blocks to review: not merged into another, with `needle` in either text, and changed if asked for."""
    kept = ~F.coalesce("is_merged", F.lit(False))
    if only_changed:
        kept &= (F.col("diff_count") > 0) | ~F.col("original_text").eqNullSafe(F.col("corrected_text"))
    if needle:
        kept &= F.lower("original_text").contains(needle.lower()) | F.lower("corrected_text").contains(needle.lower())
    return blocks.filter(kept)


def chapter_stats(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each chapter: blocks, done ones, fixed words, whether complete, progress in percent, and its title, the first heading if that is short."""
    n, done = F.count(F.lit(1)), F.count_if(F.col("status") == "completed")
    heading = F.min_by("original_text", F.when(F.col("is_heading"), F.col("block_no")))
    out = blocks.groupBy(*keys).agg(n.alias("total_blocks"), done.alias("processed_blocks"), F.sum("diff_count").cast("long").alias("fixed_words"), heading.alias("first_heading"))
    return out.withColumn("complete", F.col("processed_blocks") == F.col("total_blocks")).withColumn("progress", F.least(F.lit(100), F.floor(F.col("processed_blocks") * 100 / F.col("total_blocks") + 0.5)).cast("long")).withColumn("title", F.when(F.char_length("first_heading") < 75, F.col("first_heading"))).drop("first_heading")


def route(mode: Column, has_anomaly: Column, is_merged: Column, cached: Column, translate: Column, is_figure: Column | None = None, finished: Column | None = None) -> Column:
    """Where a block goes: skipped, left as a figure, kept as it is finished, taken from the cache, to the model, or done by the rules alone."""
    no = F.lit(False)
    before = F.when(is_merged, "skip").when(no if is_figure is None else is_figure, "figure").when(no if finished is None else finished, "kept")
    return before.when(cached, "cache").when(translate, "model").when(mode == "rules_only", "done").when(mode == "deep_llm", "model").otherwise(F.when(has_anomaly, "model").otherwise("done"))


def completed_chapters(chapters: DataFrame) -> DataFrame:
    """How many of the chapters of `chapter_stats` are complete, and how many there are."""
    return chapters.agg(F.count_if("complete").alias("completed_chapters"), F.count(F.lit(1)).alias("chapters"))


def newest_first(log: DataFrame, stamp: str, last: int) -> DataFrame:
    """The `last` entries of a log, the newest first; equal stamps in the order of the other columns."""
    return log.orderBy(F.col(stamp).desc(), *[c for c in log.columns if c != stamp]).limit(last)


def global_counters(events: DataFrame, action: Column, words: Column) -> DataFrame:
    """Counts of conversions and translations, and the words they fixed, at most 100 000 an event."""
    fixed = F.least(F.greatest(F.coalesce(words, F.lit(0.0)), F.lit(0.0)), F.lit(100000.0))
    one = lambda name: F.coalesce(F.sum(F.when(action == name, 1).otherwise(0)), F.lit(0)).cast("long")
    return events.agg(one("convert").alias("converted"), one("translate").alias("translated"), F.coalesce(F.sum(F.when(action.isin("convert", "translate"), F.floor(fixed))), F.lit(0)).cast("long").alias("words"))
