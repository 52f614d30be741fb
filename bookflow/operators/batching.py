"""Size-bounded batches, rolling context, prompts and the reading of batch responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import WS, trimmed
from bookflow.operators.chains import reached

MAX_CHARS = 15_000


def greedy_batches(blocks: DataFrame, book: str, order: str, text: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """`book, ord, batch`: a new batch starts where the next block would take a batch that has some over `max_chars`.

    Each block names the one that would start the next batch if it started one:
    the first whose running sum is too far on. Both kinds of places stand in one
    order of sums, so that is a window and no join. The batches' starts are those
    that the first block reaches, found by pointer doubling.
    """
    rows = blocks.select(F.col(book).alias("book"), F.col(order).alias("ord"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n"))
    at = W.partitionBy("book").orderBy("ord")
    rows = rows.withColumns({"node": F.row_number().over(at) - 1, "through": F.sum("n").over(at)})
    # what follows is what precedes in the reverse order: Spark computes a frame without end anew for each of its rows
    some = F.min(F.when(F.col("n") > 0, F.col("node"))).over(W.partitionBy("book").orderBy(F.desc("node")).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("some", some)
    both = F.explode(F.array(F.struct(F.col("through").alias("sum"), F.lit(0).alias("asks")), F.struct((F.col("through") - F.col("n") + max_chars).alias("sum"), F.lit(1).alias("asks")))).alias("place")
    placed = rows.select("book", "node", "some", both).select("book", "node", "some", "place.*")
    later = W.partitionBy("book").orderBy(F.desc("sum"), F.desc("asks"), F.desc("node")).rowsBetween(W.unboundedPreceding, -1)
    found = placed.withColumn("found", F.min(F.when(F.col("asks") == 0, F.col("node"))).over(later)).filter("asks = 1")
    following = F.when(F.col("found") > F.col("some"), F.col("found")).when(F.col("found").isNotNull(), F.col("some") + 1)
    last = F.max("node").over(W.partitionBy("book"))
    nodes = found.withColumns({"next": following, "last": last}).select("book", "node", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next"))
    starts = reached(nodes, "book").distinct().withColumn("starts", F.lit(1))
    numbered = rows.join(starts, ["book", "node"], "left").withColumn("batch", F.sum(F.coalesce("starts", F.lit(0))).over(at) - 1)
    return numbered.select("book", "ord", F.col("batch").cast("int").alias("batch"))


def rolling_context(rows: DataFrame, book: str, order: list[str], parts: list[Column], last: int = 3, chars: int = 300) -> Column:
    """The `last` rows before this one, each of `parts` cut to `chars`: an array of structs `c0, c1, ...`."""
    frame = W.partitionBy(book).orderBy(*order).rowsBetween(-last, -1)
    return F.collect_list(F.struct(*[F.substring(p, 1, chars).alias(f"c{i}") for i, p in enumerate(parts)])).over(frame)


# Names of languages and styles.
LANGUAGES = {"auto": "Otomatik Algıla", "tr": "Türkçe", "en": "İngilizce", "de": "Almanca", "fr": "Fransızca", "es": "İspanyolca"}


def language_name(code: Column) -> Column:
    """A language's name, or the code where it has none."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def prompt(content: Column, source: Column, target: Column, style: Column, title: Column, chapter: Column, glossary: Column, context: Column) -> Column:
    """The sections of a translation request that have content, with a blank line between them."""
    task = F.concat(F.lit("[TASK]\nSource: "), language_name(source), F.lit("\nTarget: "), language_name(target), F.lit("\nStyle: "), style)
    head = F.concat_ws("\n", F.lit("[WORK]"), F.concat(F.lit("Title: "), F.nullif(title, F.lit(""))), F.concat(F.lit("Chapter: "), F.nullif(chapter, F.lit(""))))
    terms = F.array_join(F.transform(F.map_entries(glossary), lambda e: F.concat(F.lit("- "), e["key"], F.lit(" -> "), e["value"])), "\n")
    before = F.array_join(F.transform(context, lambda c, i: F.concat(F.lit("[Before "), (i + 1).cast("string"), F.lit("]\nSource: "), c["c0"], F.lit("\nText: "), c["c1"])), "\n\n")
    return F.concat_ws(
        "\n\n", task,
        F.when(F.coalesce(title, chapter, F.lit("")) != "", head),
        F.when(F.coalesce(F.size(glossary), F.lit(0)) > 0, F.concat(F.lit("[TERMS]\n"), terms)),
        F.when(F.coalesce(F.size(context), F.lit(0)) > 0, F.concat(F.lit("[CONTEXT]\n"), before)),
        F.concat(F.lit("[BLOCKS]\n"), content),
    )


_MARK = r"\*{0,2}[\[<]/?(?:BLOCK|BLOK)[_\s]?[0-9]+[\]>]\*{0,2}"
_OPEN = r"\*{0,2}[\[<](?:BLOCK|BLOK)[_\s]?"


def sanitized(text: Column) -> Column:
    def spaced(bare: Column) -> Column:
        once = F.regexp_replace(bare, f"{WS}{{2,}}", " ")
        return trimmed(F.when(F.contains(bare, F.lit("</")), F.regexp_replace(once, f"{WS}+</", "</")).otherwise(once))

    return _bound(F.when(text.rlike("[\\[<]"), F.regexp_replace(text, f"(?i){_MARK}", "")).otherwise(text), spaced)


def unfenced(text: Column) -> Column:
    whole = trimmed(text)
    bare = trimmed(F.regexp_replace(F.regexp_replace(whole, r"^```[a-zA-Z0-9_-]*\s*\n?", ""), r"\n?```\s*\z", ""))
    return F.when(F.contains(text, F.lit("```")) & whole.startswith("```"), bare).otherwise(whole)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` the value, which is computed once: as the one element of an array, since Spark computes what a lambda repeats for each of its elements."""
    return F.transform(F.array(value), of)[0]


def parse_response(response: Column, expected: Column) -> Column:
    """The `expected` blocks of a response as an array of texts, '' for a missing one.

    Closed marks count first, the last of a number wins; open marks fill what is
    missing, the first of a number wins; numbers from 1 are shifted where there
    is no 0; a response without marks is the block itself if one is expected, or
    is split at blank lines if that gives the number expected. The response is
    read once and its marks are sorted once, whatever the number of blocks.
    """
    # a body's end can only stand at one of three signs, so it is looked for there and runs of others are taken at once
    body = lambda end: rf"((?:[^*\[<]++|(?!{end})[*\[<])*+)"
    close = r"\*{0,2}(?:\[/|</?)(?:BLOCK|BLOK)[_\s]?\2[\]>]\*{0,2}"
    closed = rf"(?is)({_OPEN}([0-9]+)[\]>]\*{{0,2}}:?{body(close)}{close})"
    opened = rf"(?is)({_OPEN}([0-9]+)[\]>]\*{{0,2}}:?{body(f'{_OPEN}[0-9]+[{chr(92)}]>]')})"

    def found(clean: Column, pattern: str) -> Column:
        numbers, bodies = F.regexp_extract_all(clean, F.lit(pattern), 2), F.regexp_extract_all(clean, F.lit(pattern), 3)
        both = F.zip_with(numbers, bodies, lambda n, b: F.struct(n.try_cast("int").alias("n"), sanitized(b).alias("t")))
        return F.filter(both, lambda p: p["t"] != "")

    def placed(marks: Column, shift: Column, rank: int, last: bool) -> Column:
        return F.transform(marks, lambda p, i: F.struct((p["n"] - shift).alias("n"), F.lit(rank).alias("rank"), (i if last else -i).alias("at"), p["t"].alias("t")))

    def by_marks(clean: Column, first: Column, second: Column) -> Column:
        # one sort finds what counts of each number: blank places, marks as numbered where numbers are shifted, open marks, closed ones
        numbers = F.concat(first["n"], second["n"])
        shift = F.when(~F.exists(numbers, lambda n: n == 0) & F.exists(numbers, lambda n: n == 1), 1).otherwise(0)
        blank = F.transform(F.slice(F.sequence(F.lit(0), expected), F.lit(1), expected), lambda i: F.struct(i.alias("n"), F.lit(0).alias("rank"), F.lit(0).alias("at"), F.lit("").alias("t")))
        every = F.concat(blank, placed(second, F.lit(0), 1, False), placed(first, F.lit(0), 2, True), placed(second, shift, 3, False), placed(first, shift, 4, True))
        marked = _bound(F.sort_array(F.filter(every, lambda p: p["n"].between(0, expected - 1))), lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["n"] != p["n"], F.lit(True)))["t"])
        parts = F.filter(F.transform(F.split(clean, r"\n\s*\n"), sanitized), lambda p: p != "")
        bare = F.when(expected == 1, F.array(sanitized(clean))).otherwise(_bound(parts, lambda some: F.when(F.size(some) == expected, some)))
        return F.when((F.size(first) == 0) & (F.size(second) == 0) & (clean != ""), F.coalesce(bare, marked)).otherwise(marked)

    def by_closed(clean: Column, first: Column) -> Column:
        enough = F.size(F.array_distinct(first["n"])) >= expected
        return _bound(F.when(enough, F.slice(first, 1, 0)).otherwise(found(clean, opened)), lambda second: by_marks(clean, first, second))

    return _bound(unfenced(F.coalesce(response, F.lit(""))), lambda clean: _bound(found(clean, closed), lambda first: by_closed(clean, first)))
