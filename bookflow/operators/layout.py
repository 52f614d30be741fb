"""Books from positioned items, as relations: items make lines, lines make notes and paragraphs, paragraphs make chapters.

Each step is a few window expressions over a page or a book and an aggregate by
what they number. All the columns of a page stay in the JVM, and no task builds
a page or a book of its own. Lines are islands: an item starts one where it lies
further below the item above it than SAME_LINE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.casing import any_case
from bookflow.functions.rules import FINISHED_ENDINGS
from bookflow.functions.text import LETTERS, UPPER, WS, trimmed
from bookflow.operators.chains import kept, reached, with_checkpoints
from bookflow.operators.pages import CHAPTER, collapse_letter_spacing, is_chapter_heading, nearest_lines, percentile, running_medians

# Raised signs, tolerances and patterns of the layout.
RAISED = {"¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "*": "1", "†": "1", "‡": "2"}
SAME_LINE, MARK_FONT, MARK_GAP, LINE_GAP = 1.8, 10.5, 25, 45
SIGNS = "".join(RAISED)
MARK = rf"^(?:[1-9][0-9]?|\[[1-9][0-9]?\]|[{SIGNS}])\z"
INLINE_MARK = r"^\[?([1-9][0-9]?)\]?\z"
NOTE = rf"(?s)^(?:\[\^?([0-9]{{1,2}}|[*†‡])\]|\^?([0-9]{{1,2}}|[*†‡])[.)]|\^?([0-9]{{1,2}}|[*†‡])(?={WS}+[\"'{UPPER}0-9])|([{SIGNS}])|(?:[dD]ipnot|[nN]ote|[fF]ootnote){WS}*([0-9]{{1,2}})?[:.]){WS}*(.*)\z"
SEPARATOR = r"^[-—_~=·•\s]{3,}\z"
CONTENTS = "İÇİNDEKİLER|iÇiNDEKiLER|İçindekiler"
NUMBER_LINE = rf"^[-—~–•*\[\]()]?{WS}*[0-9]{{1,4}}\.?{WS}*[-—~–•*\[\]()]?\z"
#: Notes are in the lower part of a page, in small type or very low; paragraphs of a chapter, and pages of one without headings.
LOW, VERY_LOW, SMALL = 0.45, 0.65, 0.94
FIXED_LEAST, AUTO_LEAST, HEADING_LEAST = 20, 35, 2


def partitions(spark: SparkSession) -> int:
    """Into how many partitions items go: as many as a shuffle has, and four for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _page(*order: str) -> W:
    return W.partitionBy("book", "page").orderBy(*order)


def _plain_signs(text: Column) -> Column:
    for sign, number in RAISED.items():
        text = F.replace(text, F.lit(sign), F.lit(f"[^{number}]"))
    return text


def page_lines(items: DataFrame, parts: int | None = None) -> DataFrame:
    """`book, page, line_no, y, min_x, max_x, font, text` from `book, page, text, x, y, width, font`, in reading order. A raised mark belongs to the nearest line that it stands by, a wide gap cuts a line.

    Items are dealt out by page once, or not at all where they are in `parts`
    partitions by a hash of their book; raised marks, few, come to where their
    page's items are. So no window or aggregate shuffles items again. Marks are
    written first: where there are none, items are gone through once.
    """
    by = ["book"] if parts else ["book", "page"]
    n = parts or partitions(items.sparkSession)
    items = items if parts else items.repartition(n, *by)
    with_checkpoints(items.sparkSession)
    rows = items.withColumns({"text": F.coalesce("text", F.lit("")), "mark": F.xxhash64("text", "x", "y", "font")})
    raised = (F.col("font") <= MARK_FONT) & trimmed(F.col("text")).rlike(MARK)
    # copies of an item stand side by side in this order, and each has the height of the first
    in_page, so_far = _page("y", "x", "mark", "width"), _page("y", "x", "mark", "width").rowsBetween(W.unboundedPreceding, W.currentRow)
    copy = F.coalesce((F.lag("mark").over(in_page) == F.col("mark")) & F.lag("width").over(in_page).eqNullSafe(F.col("width")), F.lit(False))
    far = F.coalesce(F.col("y") - F.lag("y").over(in_page) > SAME_LINE, F.lit(False))
    islands = lambda some: some.withColumns({"copy": copy, "far": far.cast("int")}).filter("NOT copy").withColumn("line", F.sum("far").over(so_far).cast("long")).drop("copy", "far")
    every = islands(rows.filter(~raised))
    marks = kept(rows.filter(raised).dropDuplicates(["book", "page", "mark", "width"]))
    if not marks.isEmpty():
        marked = every.join(marks.select("book", "page").distinct(), ["book", "page"], "left_semi")
        bounds = marked.groupBy("book", "page", "line").agg(F.min("x").alias("min_x"), F.max(F.col("x") + F.col("width")).alias("max_x"), F.avg("y").alias("line_y"))
        near = nearest_lines(marks.select("book", "page", "mark", "x", "y"), bounds, ["book", "page"]).select("book", "page", "mark", "line")
        placed = marks.join(near, ["book", "page", "mark"], "left")
        alone = islands(placed.filter("line IS NULL").drop("line")).withColumn("line", -1 - F.col("line"))
        every = every.unionByName(placed.filter("line IS NOT NULL").unionByName(alone).repartition(n, *by))
    every = every.filter("text <> ''")

    # one sort for all: a part begins where the gap is wide, so what is before an item in its part is what is before it in its line
    in_line = W.partitionBy("book", "page", "line").orderBy("x", "mark")
    each = every.withColumns({"gap": F.col("x") - F.lag(F.col("x") + F.col("width")).over(in_line), "font_before": F.lag("font").over(in_line), "text_before": F.lag("text").over(in_line)})
    first = F.coalesce(F.col("gap"), F.lit(0.0)) > LINE_GAP
    cut = each.withColumn("segment", F.sum(first.cast("int")).over(in_line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    before, text = F.when(~first, F.col("font_before")), F.col("text")
    number = F.regexp_extract(trimmed(text), INLINE_MARK, 1)
    is_mark = F.coalesce((F.col("font") <= F.least(before * 0.88, F.lit(11.0))) & (F.col("gap") <= MARK_GAP) & (number != ""), F.lit(False))
    spaced = (F.col("gap") >= F.greatest(F.lit(2.4), 0.12 * (F.col("font") + before))) | text.rlike(f"^{WS}") | F.col("text_before").rlike(f"{WS}\\z")
    part = F.when((F.octet_length(text) > F.char_length(text)) | F.contains(text, F.lit("*")), _plain_signs(text)).otherwise(text)
    piece = F.when(is_mark, F.concat(F.lit("[^"), number, F.lit("]"))).otherwise(F.concat(F.when(F.coalesce(before.isNotNull() & spaced, F.lit(False)), " ").otherwise(""), trimmed(part)))
    pieces = F.sort_array(F.collect_list(F.struct("x", "mark", "piece")))
    found = cut.withColumn("piece", piece).groupBy("book", "page", "line", "segment").agg(
        F.avg("y").alias("y"), F.min("x").alias("min_x"), F.max(F.col("x") + F.col("width")).alias("max_x"), F.max("font").alias("font"), trimmed(F.array_join(pieces["piece"], "")).alias("text")
    )
    numbered = found.filter("text <> ''").withColumn("line_no", (F.row_number().over(_page("y", "min_x", "line", "segment")) - 1).cast("int"))
    return numbered.select("book", "page", "line_no", "y", "min_x", "max_x", "font", "text")


def note_lines(lines: DataFrame, height: float) -> DataFrame:
    """`lines` (with `median`) and `note`, the number of the page's note that a line belongs to, 0 of the body; `label` and `said` of the line that opens it. Separators are gone.

    Notes begin below the first separator or small numbered line of the lower
    part; whatever has a number there opens one, and small or low lines go on.
    """
    low, very_low, small = F.col("y") >= LOW * height, F.col("y") >= VERY_LOW * height, F.col("font") <= SMALL * F.col("median")
    label = F.coalesce(*(F.nullif(F.regexp_extract("text", NOTE, k), F.lit("")) for k in range(1, 6)))
    bare = F.regexp_extract("text", NOTE, 3) != ""
    said = F.regexp_extract("text", NOTE, 6)
    opens = low & F.col("text").rlike(NOTE) & (label.isNotNull() & ~bare | said.rlike(f"^[{UPPER}0-9\"']"))
    rows = lines.withColumns({"rule": low & F.col("text").rlike(SEPARATOR), "opens": opens, "deep": small | very_low})
    above = _page("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.max(F.col("rule") | F.col("opens") & F.col("deep")).over(above), F.lit(False)))
    rows = rows.filter("NOT rule").withColumn("opens", F.col("opens") & (F.col("deep") | F.col("inside")))
    so_far = F.sum(F.col("opens").cast("int")).over(_page("line_no"))
    note = F.when(F.col("opens") | F.col("inside") & F.col("deep"), so_far).otherwise(0)
    shown = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in RAISED.items() for x in pair)), label), label, F.lit("1"))
    return rows.withColumn("note", note.cast("int")).select(*lines.columns, "note", F.when(F.col("opens"), shown).alias("label"), F.when(F.col("opens"), said).alias("said"))


def scoped_marks(text: Column, page: Column, labels: Column) -> Column:
    """Marks of the page's notes in a text of its body, by names that hold for the whole book: `[^p{page}_{label}]`."""
    name = lambda n: F.concat(F.lit("[^p"), page.cast("string"), F.lit("_"), n, F.lit("]"))
    end = r"(?=[\s.,?!:;»\"']|\z)"

    def one(t: Column, n: Column) -> Column:
        literal = F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
        kept = F.concat(F.lit("$1"), name(n))
        t = F.regexp_replace(t, F.concat(F.lit(rf"([{LETTERS}0-9.,?!:»\"']){WS}*(?:\["), literal, F.lit(r"\]|\("), literal, F.lit(rf"\)){end}")), kept)
        t = F.regexp_replace(t, F.concat(F.lit(rf"([{LETTERS}.,?!:»\"'])\^"), literal, F.lit(end)), kept)
        return F.when(n.rlike("^[0-9]+$"), F.regexp_replace(t, F.concat(F.lit(f"([{LETTERS}])"), literal, F.lit(end)), kept)).otherwise(t)

    named = F.regexp_replace(text, F.lit(r"\[\^([0-9]{1,2})\]"), F.concat(F.lit("[^p"), page.cast("string"), F.lit("_$1]")))
    return F.aggregate(F.coalesce(labels, F.array().cast("array<string>")), named, one)


def _words(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"{WS}+", " "))


def body_paragraphs(lines: DataFrame) -> DataFrame:
    """`book, page, first, kind, text` of the body's lines (with `median`): headings, and runs of lines up to one that a dash, a wide gap or a shifted start after a full stop opens. On a page of contents only its own title is a heading."""
    page = W.partitionBy("book", "page")
    contents = F.max(F.col("text").rlike(CONTENTS) | F.contains("text", F.lit("...."))).over(page)
    margins = {"left": percentile(F.collect_list("min_x").over(page), 0.15), "right": percentile(F.collect_list("max_x").over(page), 0.85)}
    heading = F.when(F.col("contents"), F.col("text").rlike(f"^(?:{CONTENTS})\\z")).otherwise(is_chapter_heading(F.col("text"), F.col("font"), F.col("median"), F.col("y")))
    above = {"above_y": F.lag("y").over(_page("line_no")), "above_end": F.lag("max_x").over(_page("line_no"))}
    rows = lines.withColumns({"contents": contents, **margins, **above}).withColumn("heading", heading)
    rows = rows.filter(F.col("heading") | ~((F.col("font") <= 1.15 * F.col("median")) & F.col("text").rlike(NUMBER_LINE)))

    last, after_heading = F.lag("text").over(_page("line_no")), F.coalesce(F.lag("heading").over(_page("line_no")), F.lit(True))
    ended = last.rlike(f"[.?!:»\"']{WS}*\\z")
    shifted = (F.col("min_x") > F.col("left") + F.greatest(F.lit(8.0), 1.25 * F.col("median"))) | (F.col("above_end") < F.col("right") - F.greatest(F.lit(25.0), 4 * F.col("median")))
    apart = F.col("y") - F.col("above_y") > 1.8 * F.col("font")
    breaks = F.col("heading") | after_heading | F.col("text").rlike(f"^[—–-]{WS}+[{LETTERS}]") | apart | ended & shifted
    word = F.regexp_extract(last, f"([{LETTERS}0-9']*[{LETTERS}0-9])-\\z", 1)
    whole = (F.char_length(word) >= 6) | word.rlike(any_case(f"(?:{FINISHED_ENDINGS})") + r"\z") | F.col("text").rlike(f"^[{UPPER}]")
    ask = F.when(last.rlike(rf"[—–]\z|{WS}-[-\s]*\z"), "dash").when(word == "", "space").when(whole, "dash").otherwise("word")
    rows = rows.withColumn("breaks", F.coalesce(breaks, F.lit(False))).withColumn("ask", F.when(~F.col("breaks"), ask))
    rows = rows.withColumns({"paragraph": F.sum(F.col("breaks").cast("int")).over(_page("line_no")), "next": F.lead("ask").over(_page("line_no"))})
    open_end = F.when((F.col("next") == "dash") & F.col("text").rlike(r"(?<! )-\z"), F.regexp_replace("text", r"-\z", " -")).when(F.col("next") == "word", F.regexp_replace("text", r"-\z", "")).otherwise(F.col("text"))
    piece = F.concat(F.when(F.col("ask").isin("space", "dash"), " ").otherwise(""), open_end)
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    out = rows.withColumn("piece", piece).groupBy("book", "page", "paragraph").agg(F.min("line_no").alias("first"), F.bool_or("heading").alias("heading"), _words(F.array_join(F.transform(pieces, lambda p: p["piece"]), "")).alias("text"))
    return out.filter("text <> ''").select("book", "page", "first", F.when(F.col("heading"), "heading").otherwise("text").alias("kind"), "text")


def line_paragraphs(lines: DataFrame, height: float) -> DataFrame:
    """`book, page, ord, kind, text, note` of lines with their page's `median`: paragraphs and headings of each page, then its notes as `[^p{page}_{label}]: text`. Lines are written once with their notes, as notes, their labels and the body are each made from them."""
    with_checkpoints(lines.sparkSession)
    marked = kept(note_lines(lines, height))
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_"), F.col("label"))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("said", "text").alias("t"))))
    notes = marked.filter("note > 0").groupBy("book", "page", "note").agg(F.min("line_no").alias("first"), F.first("label", ignorenulls=True).alias("label"), _words(F.array_join(F.transform(pieces, lambda p: p["t"]), " ")).alias("said"))
    labels = notes.groupBy("book", "page").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    body = marked.filter("note = 0").drop("note", "label", "said").join(labels, ["book", "page"], "left")
    paragraphs = body_paragraphs(body.withColumn("text", scoped_marks(F.col("text"), F.col("page"), F.col("labels"))).drop("labels"))
    said = notes.select("book", "page", "first", F.lit("note").alias("kind"), F.concat(F.lit("[^"), name, F.lit("]: "), F.col("said")).alias("text"), name.alias("note"))
    every = paragraphs.withColumn("note", F.lit(None).cast("string")).unionByName(said)
    return every.withColumn("ord", (F.row_number().over(W.partitionBy("book", "page").orderBy(F.col("kind") == "note", "first")) - 1).cast("int")).select("book", "page", "ord", "kind", "text", "note")


def page_paragraphs(items: DataFrame, height: float, parts: int | None = None) -> DataFrame:
    """`line_paragraphs` of items, the median size taken over all pages so far; `parts` as in `page_lines`."""
    medians = running_medians(items, "book", "page", "font")
    return line_paragraphs(page_lines(items, parts).join(medians, ["book", "page"]), height)


def chapters(paragraphs: DataFrame, fixed_pages: bool = False, pages: int = 15) -> DataFrame:
    """`book, chapter, title, first_page, last_page, n_paragraphs` of the paragraphs but the notes.

    A chapter's start names the start of the next: by `fixed_pages` the paragraph
    after the first that is far enough on in pages and number; else the next major
    heading, or while a book has had none the end of every `pages` pages. The
    starts are those that the first one reaches. Paragraphs are written once, as
    the starts and the counts are both made from them.
    """
    with_checkpoints(paragraphs.sparkSession)
    paragraphs = kept(paragraphs)
    book = W.partitionBy("book")
    at = book.orderBy("at")
    title = collapse_letter_spacing(trimmed(F.col("text")))
    major = (F.col("kind") == "heading") & (F.char_length("text") < 80) & (title.rlike(CHAPTER) | title.rlike(any_case(r"^(?:[0-9]{1,2}|[IVXLCDM]{1,6})\.?\z")))
    rows = paragraphs.filter("kind <> 'note'").withColumn("at", F.row_number().over(book.orderBy("page", "ord")) - 1)
    rows = rows.withColumns({"name": title, "major": F.coalesce(major, F.lit(False)), "short": (F.col("kind") == "heading") & (F.char_length("text") < 80), "begin": F.coalesce(F.lag("page").over(at) + 1, F.col("page"))})
    ahead = lambda test, least: F.min(F.when(test, F.col("at"))).over(at.rowsBetween(least, W.unboundedFollowing))
    if fixed_pages:
        first_on = F.min("at").over(book.orderBy("page").rangeBetween(pages, W.unboundedFollowing))
        end = F.greatest(F.when(F.col("at") == 0, F.col("first_on")).otherwise(F.col("later_on")), F.col("at") + FIXED_LEAST - 1)
        rows = rows.withColumn("first_on", first_on).withColumn("after", F.min("at").over(book.orderBy("page").rangeBetween(pages + 1, W.unboundedFollowing))).withColumn("later_on", F.lag("after").over(at))
        last = F.max("at").over(book)
        nodes = rows.withColumn("next", F.when(end < last, end + 1)).withColumn("node", F.col("at"))
    else:
        by_heading = F.when(F.col("at") >= 0, ahead(F.col("major"), HEADING_LEAST))
        by_page = ahead(F.col("page") % pages == 0, AUTO_LEAST - 1) + 1
        last = F.max("at").over(book)
        both = rows.withColumns({"by_heading": by_heading, "by_page": by_page, "last": last})
        # node 2 * at: no heading has begun a chapter yet; 2 * at + 1: one has
        page_first = (F.col("by_page") <= F.col("by_heading")) | F.col("by_heading").isNull()
        none_yet = F.when(page_first & (F.col("by_page") <= F.col("last")), 2 * F.col("by_page")).otherwise(2 * F.col("by_heading") + 1)
        nodes = both.withColumn("some", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("node", 2 * F.col("at") + F.col("some")).withColumn("next", F.when(F.col("some") == 0, none_yet).otherwise(2 * F.col("by_heading") + 1))
    starts = reached(nodes.select("book", "node", "next"), "book")
    place, by_heading = (F.col("node"), F.lit(0)) if fixed_pages else (F.floor(F.col("node") / 2), F.col("node") % 2)
    starts = starts.select("book", place.cast("int").alias("at"), by_heading.cast("int").alias("by_heading"), F.lit(1).alias("starts"))
    rows = rows.join(starts, ["book", "at"], "left").withColumn("chapter", F.sum(F.coalesce("starts", F.lit(0))).over(at).cast("int"))
    of = rows.groupBy("book", "chapter").agg(F.min_by(F.struct("name", "short", "by_heading", "begin", "page"), "at").alias("s"), F.max("page").alias("last"), F.count(F.lit(1)).cast("int").alias("n_paragraphs"))
    number, is_first, headed = F.col("chapter").cast("string"), F.col("chapter") == 1, F.col("s.by_heading") == 1
    start = F.when(is_first | headed, F.col("s.page")).otherwise(F.col("s.begin")).cast("int")
    shown = F.when(is_first, F.lit(1)).otherwise(start)
    pages_named = F.concat(F.lit("Kısım "), number, F.lit(" (Sayfa "), shown.cast("string"), F.lit("-"), (shown + pages - 1).cast("string"), F.lit(")"))
    plain = F.when(is_first, F.col("book").cast("string")).otherwise(F.concat(F.lit("Bölüm "), number, F.lit(" (Sayfa "), start.cast("string"), F.lit(")")))
    named = pages_named if fixed_pages else F.when(headed | is_first & F.col("s.short"), F.col("s.name")).otherwise(plain)
    follows = F.lead("s").over(book.orderBy("chapter"))
    until = F.when(follows["by_heading"] == 1, follows["page"]).otherwise(F.col("last"))  # a heading's page belongs to both
    return of.select("book", "chapter", named.alias("title"), start.alias("first_page"), until.cast("int").alias("last_page"), "n_paragraphs")
