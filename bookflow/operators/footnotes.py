"""Footnotes as tables: definitions, references, numbers, and where orphans belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import escape_xml

#: Pages of a band.
PAGES = 16


def last_definitions(definitions: DataFrame) -> DataFrame:
    """`book, tag, page, note`: of a tag's definitions the one that comes last."""
    return definitions.groupBy("book", "tag").agg(F.max_by(F.struct("page", "note"), "pos").alias("d")).select("book", "tag", "d.page", "d.note")


def numbered(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """`book, tag, number, note`: tags numbered from 1 by their first reference, with their definition if there is one. Both tables are dealt out by book as one, and stay so."""
    both = references.select("book", "tag", F.col("pos").alias("ref")).unionByName(definitions.select("book", "tag", "note", F.col("pos").alias("def")), allowMissingColumns=True)
    note = F.when(F.col("book").isNotNull() & F.col("tag").isNotNull(), F.max_by("note", "def"))
    named = both.repartition("book").groupBy("book", "tag").agg(F.min("ref").alias("pos"), F.count("ref").alias("refs"), note.alias("note")).filter("refs > 0")
    order = F.row_number().over(W.partitionBy("book").orderBy("pos", "tag"))
    return named.select("book", "tag", order.alias("number"), "note")


def numbered_by_definition(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """`book, tag, number, note`: tags numbered from 1 by their first definition, and after those the tags that are only referred to, by their first reference. A tag's first definition is its note; '' where it has none."""
    defined = definitions.groupBy("book", "tag").agg(F.min("pos").alias("pos"), F.min_by("note", "pos").alias("note"))
    named = references.groupBy("book", "tag").agg(F.min("pos").alias("ref"))
    both = defined.join(named, ["book", "tag"], "full")
    order = F.row_number().over(W.partitionBy("book").orderBy(F.col("pos").isNull(), F.coalesce("pos", "ref"), "tag"))
    return both.select("book", "tag", order.alias("number"), F.coalesce("note", F.lit("")).alias("note"))


def orphans(references: DataFrame, definitions: DataFrame, chapters: DataFrame) -> DataFrame:
    """`book, tag, note, chapter`: definitions that nothing refers to, in the first chapter whose pages hold theirs.

    Chapters stand in each band of PAGES pages that they touch, so the join's equal
    key holds the band, and a note meets the chapters near its page alone.
    """
    alone = last_definitions(definitions).join(references.select("book", "tag").distinct(), ["book", "tag"], "left_anti")
    band = lambda c: F.floor(F.col(c) / PAGES)
    bands = chapters.filter("start_page <= end_page").withColumn("band", F.explode(F.sequence(band("start_page"), band("end_page"))))
    held = alone.withColumn("band", band("page")).join(bands, ["book", "band"]).filter(F.col("page").between(F.col("start_page"), F.col("end_page")))
    return held.groupBy("book", "tag", "note").agg(F.min("chapter").alias("chapter"))


_MARK = r"\[\^([A-Za-z0-9_:-]+)\]"


def _cut(text: Column) -> Column:
    """A text as an array of `tag, after`: what stands before its first mark, without a tag, and each mark's tag with what follows it."""
    text = F.coalesce(text, F.lit(""))
    tags = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(_MARK), 1))
    return F.zip_with(tags, F.split(text, _MARK, -1), lambda tag, after: F.struct(tag.alias("tag"), after.alias("after")))


def resolve(bodies: DataFrame, numbers: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys, text`: bodies with each `[^tag]` as its number in brackets, or gone where it has none.

    Bodies and numbers are dealt out by book as one table, before bodies are cut at
    their marks; a tag's number comes first among its marks and is carried on.
    """
    own = list(dict.fromkeys([*keys, "book"]))
    named = numbers.select("book", F.col("tag").cast("string").alias("_tag"), F.col("number").alias("_number"))
    every = bodies.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_text")).unionByName(named, allowMissingColumns=True).repartition("book")
    parts = F.when(F.col("_text").isNull(), F.array(F.struct(F.col("_tag").alias("tag"), F.lit("").alias("after")))).otherwise(_cut(F.col("_text")))
    pieces = every.select(*own, F.col("_text").isNotNull().alias("_body"), "_number", F.posexplode(parts).alias("_place", "_part"))
    before = W.partitionBy("book", "_part.tag").orderBy("_body").rowsBetween(W.unboundedPreceding, 0)
    number = F.when(F.col("book").isNotNull() & F.col("_part.tag").isNotNull(), F.max("_number").over(before))
    shown = F.concat(F.coalesce(F.concat(F.lit("["), F.col("_shown").cast("string"), F.lit("]")), F.lit("")), F.col("_part.after"))
    joined = pieces.withColumn("_shown", number).filter("_body").select(*own, F.struct("_place", shown.alias("shown")).alias("_piece"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("_piece")), lambda p: p["shown"]), "")
    return joined.groupBy(*own).agg(whole.alias(text)).select(*keys, text)


def linked(bodies: DataFrame, definitions: DataFrame) -> DataFrame:
    """`book, kind, ord, html`: paragraphs `book, pos, text` with their `[^tag]` marks as anchors, and the notes (`book, tag, note`, one a tag) as asides with links back.

    Tags are numbered by their first mark; those that nothing refers to come
    after them, by tag. Marks without a definition go, and every other mark of a
    note has an id of its own, which its aside leads back to. Paragraphs and notes
    are one table, dealt out by book once: paragraphs are cut at their marks, marks
    and notes meet in windows of their tag, and a ranking of tags numbers both.
    """
    notes = definitions.select("book", F.col("tag").cast("string").alias("tag"), F.coalesce("note", F.lit("")).alias("note"), F.lit(True).alias("is_note"))
    every = bodies.select("book", "pos", "text", F.lit(False).alias("is_note")).unionByName(notes, allowMissingColumns=True)
    rows = every.withColumn("ord", F.row_number().over(W.partitionBy("book").orderBy("is_note", "pos")))
    parts = F.when(F.col("is_note"), F.array(F.struct("tag", F.lit("").alias("after")))).otherwise(_cut(F.col("text")))
    pieces = rows.select("book", "ord", "is_note", "note", F.posexplode(parts).alias("place", "part")).select("book", "ord", "is_note", "note", "place", "part.*")

    is_mark = ~F.col("is_note") & F.col("tag").isNotNull()
    in_tag = W.partitionBy("book", "tag").orderBy("is_note", "ord", "place")
    of_tag = in_tag.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pieces = pieces.withColumns({"time": F.row_number().over(in_tag), "first": F.min(F.when(is_mark, F.struct("ord", "place"))).over(of_tag), "marks": F.count_if(is_mark).over(of_tag), "noted": F.max("is_note").over(of_tag)})
    pieces = pieces.withColumn("known", F.col("is_note") | is_mark & F.col("noted"))
    number = F.dense_rank().over(W.partitionBy("book").orderBy(F.desc("known"), F.col("first").isNull(), "first", "tag"))
    pieces = pieces.withColumn("number", number)

    n, k = F.col("number").cast("string"), F.col("time").cast("string")
    anchor = F.concat(F.lit('<a id="ref-'), n, F.lit("-"), k, F.lit('" href="#note-'), n, F.lit('">['), n, F.lit("]</a>"))
    back = F.transform(F.when(F.col("marks") > 0, F.sequence(F.lit(1), F.col("marks").cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit(' <a href="#ref-'), n, F.lit("-"), i.cast("string"), F.lit('">^</a>')))
    aside = F.concat(F.lit('<aside id="note-'), n, F.lit('"><p>'), n, F.lit(". "), escape_xml(F.col("note")), F.array_join(back, ""), F.lit("</p></aside>"))
    html = F.when(F.col("is_note"), aside).otherwise(F.concat(F.when(F.col("known"), anchor).otherwise(""), escape_xml(F.col("after"))))
    shown = pieces.select("book", "ord", "is_note", F.when(F.col("is_note"), F.col("number")).alias("number"), F.struct("place", html.alias("html")).alias("piece"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["html"]), "")
    out = shown.groupBy("book", "ord", "is_note").agg(whole.alias("html"), F.max("number").alias("number"))
    return out.select(
        "book", F.when(F.col("is_note"), "note").otherwise("body").alias("kind"), F.coalesce("number", "ord").alias("ord"),
        F.when(F.col("is_note"), F.col("html")).otherwise(F.concat(F.lit("<p>"), F.col("html"), F.lit("</p>"))).alias("html"),
    )
