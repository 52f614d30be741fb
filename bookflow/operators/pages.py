"""Page measures and predicates over positioned lines and items, as aggregates, windows and boolean expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.headings import OPENERS, ORDINALS
from bookflow.functions.literal_rules import both_cases
from bookflow.functions.text import LETTERS, LOWER, UPPER, WS, round_half_up, trimmed
from bookflow.operators.chains import kept, with_checkpoints

# Margins of the crop presets as fractions of the page's height: top, bottom, whether all lines stay.
CROP_PRESETS = {"full": (0.0, 0.0, True), "novel": (0.05, 0.02, False), "wide": (0.08, 0.04, False)}


def page_boxes(items: DataFrame, keys: list[str], x: str, y: str, width: str, page_width: Column, page_height: Column) -> DataFrame:
    """Bounds of each page's items, and the crop that they recommend: hundredths, rounded down, from 0 to 0.25."""
    box = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.min(x).alias("left"), F.max(F.col(x) + F.col(width)).alias("right"), F.min(y).alias("top"), F.max(y).alias("bottom"))
    part = lambda share: F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(0.25)) * 100) / 100
    return box.select("*", part(F.col("left") / page_width).alias("crop_left"), part(1 - F.col("right") / page_width).alias("crop_right"), part(F.col("top") / page_height).alias("crop_top"), part(1 - F.col("bottom") / page_height).alias("crop_bottom"))


def clamp_crop(share: Column) -> Column:
    """A share entered by hand: two decimals, from 0 to 0.35."""
    return round_half_up(F.least(F.greatest(share, F.lit(0.0)), F.lit(0.35)) * 100) / 100


def inside_crop(y: Column, left: Column, right: Column, page_width: Column, page_height: Column, crop: dict[str, float]) -> Column:
    outside = (y < page_height * crop["top"]) | (y > page_height * (1 - crop["bottom"])) | (right < page_width * crop["left"]) | (left > page_width * (1 - crop["right"]))
    return ~outside


def representative_pages(pages: DataFrame, book: str, page: str, items: str) -> DataFrame:
    """`book, page`: of a few pages across a book the one with most items, the first of equals."""
    sizes = pages.groupBy(book).agg(F.max(page).cast("int").alias("n_pages"))
    at = lambda share: F.greatest(F.lit(1), round_half_up(F.col("n_pages") * share).cast("int"))
    fixed = F.filter(F.array(F.lit(5), F.lit(10)), lambda k: k <= F.col("n_pages"))
    few = sizes.select(book, F.explode(F.array_distinct(F.concat(F.array(*[at(s) for s in (0.2, 0.35, 0.5, 0.65, 0.8)], F.lit(1)), fixed))).alias(page))
    return pages.join(few, [book, page]).groupBy(book).agg(F.min_by(page, F.struct(-F.col(items), F.col(page))).alias(page))


def scanned_pages(items: DataFrame, sizes: DataFrame, book: str, page: str) -> DataFrame:
    """`book, page`: the pages of each book, as many as `sizes` (`book, n_pages`) says it has, that have no item."""
    every = sizes.filter("n_pages > 0").select(book, F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias(page))
    return every.join(items.select(book, page), [book, page], "left_anti")


def running_medians(items: DataFrame, book: str, page: str, size: str) -> DataFrame:
    """`book, page, median`: of the sizes on all pages so far, the one at place floor(n / 2) from 0.

    Sizes have few values, so their counts are summed over pages for each value,
    and over values for each page: as many rows as pages times sizes of a book.
    The counts are written once, as three steps ask for them.
    """
    with_checkpoints(items.sparkSession)
    counts = kept(items.groupBy(book, page, size).agg(F.count(F.lit(1)).alias("n")))
    grid = counts.select(book, page).distinct().join(counts.select(book, size).distinct(), book)
    up_to = W.partitionBy(book, size).orderBy(page)
    so_far = grid.join(counts, [book, page, size], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(up_to))
    by_size = W.partitionBy(book, page).orderBy(size)
    ranked = so_far.withColumn("through", F.sum("n").over(by_size)).withColumn("all", F.sum("n").over(W.partitionBy(book, page)))
    return ranked.filter(F.col("through") > F.floor(F.col("all") / 2)).groupBy(book, page).agg(F.min(size).alias("median"))


def percentile(values: Column, share: float) -> Column:
    """The element at place floor(n * share) from 0 of an array, sorted."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) * share) + 1).cast("int"))


_SIGN = r"[-—~–•*\[\]()]?"


def is_header_or_footer(text: Column, y: Column, font: Column, page_height: Column, median: Column, page: Column, top: float, bottom: float, keep_all: bool = False) -> Column:
    """Whether a line is a running head, foot or page number, by place, length and form."""
    if keep_all:
        return F.lit(False)
    t = trimmed(text)
    at_top, at_bottom = y <= page_height * top, y >= page_height * (1 - bottom)
    number = t.rlike(rf"^{_SIGN}{WS}*[0-9]{{1,4}}\.?{WS}*{_SIGN}\z") | t.rlike(rf"^{_SIGN}{WS}*[IVXLCDMivxlcdm]{{1,8}}\.?{WS}*{_SIGN}\z") | t.rlike(rf"^(?:{both_cases('sayfa')}|{both_cases('page')}|[sS]\.){WS}*[0-9]{{1,4}}\.?\z")
    own = F.regexp_replace(t, r"[-—~–•*\[\]()\s.]", "") == page.cast("string")
    open_end = ~t.rlike(r"[.?!]\z")
    outer = (at_top | at_bottom) & (number | own | at_top & (F.char_length(t) <= 80) & open_end | at_bottom & (F.char_length(t) <= 60) & open_end)
    near = F.abs(F.try_to_number(F.regexp_replace(t, r"\.", ""), F.lit("9999")).cast("int") - page) <= 1
    edge = (y <= F.greatest(page_height * top, page_height * 0.1)) | (y >= F.least(page_height * (1 - bottom), page_height * 0.9))
    return outer | F.coalesce((font <= median * 1.15) & t.rlike(r"^[0-9]{1,4}\.?\z") & near & edge, F.lit(False))


_any_case = lambda words: "|".join(both_cases(w.lower() if w.isascii() else w).replace(" ", f"{WS}+") for w in words)
_ENDS = "(?![A-Za-z0-9_])"
CHAPTER = rf"^(?:(?:{_any_case(ORDINALS)}){WS}+(?:{_any_case(['BÖLÜM', 'KISIM'])})|(?:{_any_case(['BÖLÜM', 'KISIM', 'CHAPTER', 'PART'])}){WS}*(?:[0-9]{{1,3}}|[IVXLCDMivxlcdm]{{1,6}})?|{_any_case(['GİRİŞ', 'ÖNSÖZ'])}|{both_cases('SON'.lower())}{WS}*{both_cases('SÖZ')}|{_any_case(['EPİLOG', 'PROLOG', 'İÇİNDEKİLER'])}){_ENDS}"


def collapse_letter_spacing(text: Column) -> Column:
    """Single letters with white space between them, three or more, without it: each gap between two lone letters of such a run goes."""
    one = f"[{LETTERS}0-9]"
    lone = rf"(?<![A-Za-z0-9_]){one}(?:{WS}+{one}){{2,}}(?![A-Za-z0-9_])"
    runs = F.regexp_extract_all(text, F.lit(f"({lone})"), 1)
    return F.aggregate(runs, text, lambda t, run: F.replace(t, run, F.regexp_replace(run, f"{WS}+", "")))


def is_chapter_heading(text: Column, font: Column, median: Column, y: Column) -> Column:
    """Whether a line is a chapter heading: a known word, or a large numeral or short title."""
    t = trimmed(text)
    n = collapse_letter_spacing(t)
    could = (t != "") & (F.char_length(t) <= 60) & (y > 48) & t.rlike(f"^[{UPPER}0-9\"']") & ~t.rlike(rf"[.?!]{WS}+[{UPPER}]") & ~t.rlike(r"\.{4,}")
    named = (n.rlike(CHAPTER) | t.rlike(CHAPTER)) & ~n.rlike(f"^(?:{both_cases('kısım')}:|{_any_case(['bölümde', 'bölümden', 'bölümü'])}){_ENDS}")
    end = t.rlike(rf"^(?:SONUÇ|Sonuç|sonuç)(?:{WS}+{both_cases('BÖLÜMÜ')})?{WS}*:?\z")
    numeral = n.rlike(rf"^(?:{both_cases('bölüm')}{WS}*)?(?:[0-9]{{1,2}}|[IVXLCDMivxlcdm]{{1,6}})\.?\z") & (font >= median * 1.35)
    caps = (n == F.upper(n)) & n.rlike(f"[{UPPER}]")
    title = n.rlike(f"^[{UPPER}]") & ~n.rlike(f"[{LOWER}]+[{UPPER}]")
    large = (font >= median * 1.75) & (F.char_length(t) <= 35) & ~t.rlike("[.,;!?:…»\"']\\z") & ~t.rlike(f"^(?:{_any_case(OPENERS)}){_ENDS}") & (F.char_length(n) >= 3) & (caps | title)
    return could & (named | end | numeral | large)


def split_lines(items: DataFrame, keys: list[str], order: list[str], x: str, width: str, gap: float = 45) -> DataFrame:
    """`items` with `segment`: a line is cut where an item begins more than `gap` after the one before ends."""
    in_line = W.partitionBy(*keys).orderBy(*order)
    far = F.col(x) - F.lag(F.col(x) + F.col(width)).over(in_line) > gap
    return items.withColumn("cut", F.coalesce(far, F.lit(False)).cast("int")).withColumn("segment", F.sum("cut").over(in_line).cast("int")).drop("cut")


def line_texts(items: DataFrame, keys: list[str], order: list[str], text: str, x: str, width: str, font: str) -> DataFrame:
    """`keys, text`: items of a line joined, with a space where the gap is at least 2.4 and 0.24 of the mean font."""
    in_line = W.partitionBy(*keys).orderBy(*order)
    gap = F.col(x) - F.lag(F.col(x) + F.col(width)).over(in_line)
    wide = gap >= F.greatest(F.lit(2.4), 0.24 * (F.col(font) + F.lag(font).over(in_line)) / 2)
    edge = F.col(text).rlike(f"^{WS}") | F.lag(text).over(in_line).rlike(f"{WS}\\z")
    part = F.concat(F.when(F.coalesce(wide | edge, F.lit(False)), " ").otherwise(""), trimmed(F.col(text)))
    rows = items.withColumn("part", part)
    parts = F.sort_array(F.collect_list(F.struct(*order, "part")))
    return rows.groupBy(*keys).agg(trimmed(F.array_join(F.transform(parts, lambda p: p["part"]), "")).alias("text"))


#: How far a raised mark may be from its line, above or below; the height of a band.
MARK_AWAY = 8.5


def nearest_lines(marks: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each raised mark (`mark, x, y`) with the nearest line (`line, min_x, max_x, line_y`) of its page: at most MARK_AWAY away, from 15 before its start to 25 after its end; the first of equals.

    Pages are cut into bands of that height. A mark asks its own band and both
    beside it, so the join's equal key holds the band, and a mark meets the lines
    near it and not all of its page.
    """
    band = lambda y: F.floor(F.col(y) / MARK_AWAY)
    asks = marks.withColumn("band", F.explode(F.array(*(band("y") + k for k in (-1, 0, 1)))))
    near = (F.abs(F.col("y") - F.col("line_y")) <= MARK_AWAY) & (F.col("x") >= F.col("min_x") - 15) & (F.col("x") <= F.col("max_x") + 25)
    both = asks.join(lines.withColumn("band", band("line_y")), [*keys, "band"]).filter(near)
    return both.groupBy(*keys, "mark").agg(F.min(F.struct(F.abs(F.col("y") - F.col("line_y")).alias("away"), F.col("line"))).alias("m")).select(*keys, "mark", "m.line", "m.away")


def table_of_contents(lines: DataFrame, book: str, order: str, text: str, ahead: int = 6, least_page: int = 10) -> DataFrame:
    """`book, target, first`: pages that dot leaders point at within `ahead` lines, and the first line that does."""
    frame = W.partitionBy(book).orderBy(order).rowsBetween(0, ahead - 1)
    window = F.array_join(F.collect_list(text).over(frame), "\n")
    found = lines.withColumn("_window", window).select(book, order, F.explode(F.regexp_extract_all("_window", F.lit(r"\.{3,}\s*([0-9]{1,3})(?![0-9])"), 1)).alias("target"))
    return found.select(book, order, F.col("target").cast("int").alias("target")).filter(F.col("target") >= least_page).groupBy(book, "target").agg(F.min(order).alias("first"))
