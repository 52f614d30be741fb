"""Operator 6: main text of web pages, by repeated substrings of each host's token streams.

Each page becomes blocks of text with what its markup says of them, and a stream
of words. The suffixes of all streams of a host are one distributed table, by
the hash of the host and their first RUN words: a group of equal hashes is a
stretch of the host's suffix array. Of a substring of LENGTH words at least one of its suffixes
is in the table, as the least hash of each WINDOW neighbours is kept (it depends
on the words alone). Spark counts the distinct articles of each group, over the
whole host. What is on enough of them is boilerplate; a page's stream is covered
from hit to hit, covered words are removed, and unique runs are kept.

Markup is evidence: blocks in menus, headers, footers, asides, forms, scripts,
adverts, notices and reader comments always go, and where a page has an
<article> or <main>, only blocks of one stay. Names that only sound like an
article (a class of body or content) count if their blocks hold more text than
all others, and never against a name that says what goes. On the rest of a page a substring
goes that is on LEAST_SHARE of the host's articles. Articles themselves quote
and repeat lines, so in them it has to be on ARTICLE_SHARE of them, as notices
of a template are. Copies of one article repeat too: pages whose articles have
the same least hash of word pairs (copies have, with the probability of their
similarity) count as one article.

Defined cases: null html is empty and has no text; unclosed, misnested and
unended markup and stray quotes are read as browsers do, in linear time; a null
url is a host of its own; repeated rows each get their row; an empty table gives
an empty one; other columns of the input aren't carried.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import forget, table, written
from bookflow.llm.wordhash import anchors, runs, word_hashes

LENGTH, RUN = 12, 5
WINDOW = LENGTH - RUN + 1
#: Boilerplate is on so many articles of a host, and on such a share of them; within articles on more.
LEAST_PAGES, LEAST_SHARE = 3, 0.1
ARTICLE_PAGES, ARTICLE_SHARE = 5, 0.5
#: The level of <main>; articles have a higher one.
MAIN = 2

# Names of elements and words in class, id and role.
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mspace mstyle mfenced menclose semantics".split()
)
_DROPPED = frozenset("nav header footer aside form button select option menu head fieldset datalist".split()) | _RAW
# A class, id or role with one of these words drops an element wherever it is, unless it has one of _ABOUT, by which it speaks of a layout.
_NAMED_DROPPED = frozenset(
    "ads advert adverts advertisement advertising adbox adslot adsense sponsored taboola outbrain cookie cookies cookiebar consent gdpr notice notices disclaimer "
    "sidebar sidebars comments commentlist disqus respond replies".split()
)
# Of these words alone, or of them and words for places, too; in an article only those of the first list do.
_ALWAYS_DROPPED = _NAMED_DROPPED | frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored banner taboola outbrain cookie cookies cookiebar consent gdpr notice notices disclaimer "
    "sidebar sidebars menu menus nav navbar navigation topbar breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus".split()
)
_DROPPED_OUTSIDE = _ALWAYS_DROPPED | frozenset(
    "promo promotion alert copyright legal rail reply replies respond responses discussion feedback related recommended "
    "share sharing social teaser teasers newsletter subscribe subscription signup login popup modal overlay pager pagination toolbar widget widgets skip paywall".split()
)
_PLACES = frozenset("box slot bar banner container wrapper wrap area section list block inner outer unit top bottom left right main site page global id link links item items form thread policy post posts".split())
_ABOUT = frozenset("has with no not without layout hide show open closed count".split())
_BODY_WORDS = frozenset("content article post entry story main body text articlebody".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: One attribute, or the tag's end. A quote counts only where a value begins.
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
_SAYS = frozenset("class id role itemprop style aria-hidden hidden".split())
_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I | re.A) for tag in _RAW}


def _dropped_name(parts: list[str], words: frozenset[str]) -> bool:
    if not _ABOUT.isdisjoint(parts):
        return False
    return any(p in _NAMED_DROPPED for p in parts) or any(p in words for p in parts) and all(p in words or p in _PLACES or p in _BODY_WORDS or p.isdigit() for p in parts)


def _meaning(tag: str, attributes: list[tuple[str, str]], level: int, dropped: bool) -> tuple[int, bool]:
    """How strongly an element says that it is the article (3, 2, 1 or 0), and whether it is none of it; from its own and its parent's."""
    if tag in _DROPPED:
        return level, True
    own = 3 if tag == "article" else 2 if tag == "main" else 0
    if tag not in ("html", "body"):
        words = _ALWAYS_DROPPED if max(own, level) >= MAIN else _DROPPED_OUTSIDE
        for name, value in attributes:
            if name == "itemprop" and value.lower() == "articlebody" or name == "role" and value.lower() == "main":
                own = max(own, 2)
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value.lower() == "true":
                dropped = True
            elif name in ("class", "id", "role"):
                for one in value.split():
                    parts = [p.lower() for p in _PART.findall(one)]
                    if _dropped_name(parts, words):
                        dropped = True
                    elif parts and parts[-1] in _BODY_WORDS and words.isdisjoint(parts):
                        own = max(own, 1)
    return max(level, own), dropped


def blocks(page: str | None) -> list[tuple[str, int, bool, int]]:
    """`text, level, dropped, words in links` of each block, in page order; the words of a paragraph don't count as links."""
    page = page or ""
    out, stack, parts = [], [], []
    level, dropped, linked, links = 0, False, 0, 0
    open_at: dict[str, list[int]] = {}
    not_inline: list[int] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, level, dropped, 0 if open_at.get("p") else linked))
            parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal level, dropped, links
        if any(t not in _INLINE for t, *_ in stack[depth:]) or stack[depth][2] != dropped:
            flush()
        links -= sum(t == "a" for t, *_ in stack[depth:])
        _, level, dropped = stack[depth]
        for t, *_ in stack[depth:]:
            open_at[t].pop()
        while not_inline and not_inline[-1] >= depth:
            not_inline.pop()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        opens = page.find("<", at)
        if opens < 0:
            opens = end
        if opens > at:
            parts.append(page[at:opens])
            if links:
                linked += len(page[at:opens].split())
        if opens == end:
            break
        follows = page[opens + 1 : opens + 2]
        if follows in ("!", "?"):
            comment = page.startswith("<!--", opens)
            closes = page.find("-->" if comment else ">", opens + 2)
            at = end if closes < 0 else closes + (3 if comment else 1)
            continue
        closing = follows == "/"
        m = _NAME.match(page, opens + 1 + closing)
        if not m:
            parts.append("<")
            at = opens + 1
            continue
        tag, attributes, at, bare = m[0].lower(), [], m.end(), False
        while m := _ATTRIBUTE.match(page, at):
            at = m.end()
            if m[1]:
                bare = page[at - 2] == "/"
                break
            if m[2].lower() in _SAYS:
                attributes.append((m[2].lower(), m[3] or m[4] or m[5] or ""))
        else:
            at = end
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if closing:
            if open_at.get(tag):
                leave(open_at[tag][-1])
            elif tag not in _INLINE:
                flush()
            continue
        if tag in _RAW:
            flush()
            closes = _RAW_END[tag].search(page, at)
            at = closes.start() if closes else end
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                flush()
            continue
        if tag not in _INLINE:
            flush()
            if not_inline and (stack[not_inline[-1]][0] == "p" or stack[not_inline[-1]][0] in _CLOSED_BY.get(tag, ())):
                leave(not_inline[-1])
        after_level, after = _meaning(tag, attributes, level, dropped)
        if tag in _HEADINGS and level >= MAIN:  # the header of an article or <main> holds its title
            after = stack[open_at["header"][0]][2] if open_at.get("header") else after
        if after != dropped:
            flush()
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in _INLINE:
            not_inline.append(len(stack))
        stack.append((tag, level, dropped))
        links += tag == "a"
        level, dropped = after_level, after
        if bare and tag not in _INLINE:
            leave(len(stack) - 1)
    flush()
    return out


Block = tuple[str, int, bool, int]


def stream(page: list[Block]) -> np.ndarray:
    """The hashes of a page's words, block after block."""
    return word_hashes("\n".join(b[0] for b in page).encode("utf-8", "surrogatepass"))


def article_key(page: list[Block], other: int) -> int:
    """The least hash of the word pairs in the page's article; `other` where it has none."""
    words = stream([b for b in page if not b[2] and b[1] >= MAIN])
    return int(runs(words, 2).min().view(np.int64)) if len(words) > 1 else other


def host_runs(words: np.ndarray, host: int) -> np.ndarray:
    """The hash of the host and the RUN words from each word on."""
    return (runs(words, RUN) ^ np.int64(host).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def kept_runs(words: np.ndarray, host: int) -> np.ndarray:
    """The distinct hashes that are the least of some WINDOW neighbours."""
    all_runs = host_runs(words, host)
    return np.unique(all_runs[anchors(all_runs, WINDOW)[1]])


def covered(words: np.ndarray, host: int, known: np.ndarray) -> np.ndarray:
    """A mask of the words in runs whose hash is in `known`, and between two such runs that begin at most WINDOW words apart."""
    at = np.flatnonzero(np.isin(host_runs(words, host), known))
    mask = np.zeros(len(words) + 1, np.int64)
    if len(at):
        follows = np.append(np.diff(at) <= WINDOW, False)
        ends = np.where(follows, np.append(at[1:], 0), at + RUN)
        np.add.at(mask, at, 1)
        np.add.at(mask, ends, -1)
    return mask.cumsum()[:-1] > 0


def unique_runs(text: str, words: np.ndarray, mask: np.ndarray, host: int, known: np.ndarray) -> str:
    """`text` without its covered words, where they are LENGTH in a row: a repeated substring may reach a little into the next block. A block goes whole if all of its own least hashes are known, or all of its words covered."""
    own = kept_runs(words, host)
    if mask.all() or len(own) and np.isin(own, known).all():
        return ""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    gone = np.zeros(len(mask), bool)
    for first, end in zip(edge[::2], edge[1::2], strict=True):
        gone[first:end] = end - first >= LENGTH
    return " ".join(w for w, is_gone in zip(text.split(" "), gone.tolist(), strict=False) if not is_gone)


NOTHING = np.zeros(0, np.uint64)


def main_text(page: list[Block], host: int = 0, outside: np.ndarray = NOTHING, inside: np.ndarray = NOTHING) -> str:
    """The blocks that stay. `outside` and `inside` are the hashes of runs that are boilerplate of the host out of and in articles."""
    best = max((b[1] for b in page if not b[2]), default=0)
    if best == 1:  # by a name alone
        held = [sum(len(b[0]) for b in page if not b[2] and b[1] == k) for k in (0, 1)]
        best = int(held[1] >= held[0])
    words = stream(page)
    known = {False: outside, True: inside}
    masks = {k: covered(words, host, v) if len(v) else None for k, v in known.items()}
    kept, at = [], 0
    for text, level, dropped, linked in page:
        n = len(text.encode("utf-8", "surrogatepass").split())
        here, at = slice(at, at + n), at + n
        if dropped or level < min(best, MAIN) or linked == n > 0 == best:
            continue
        mask = masks[level >= MAIN]
        if n and mask is not None and mask[here].any():
            text = unique_runs(text, words[here], mask[here], host, known[level >= MAIN])
        if text:
            kept.append(text)
    return "\n".join(kept)


def boilerplate(rows: DataFrame) -> DataFrame:
    """From `page, host, html`: `page, outside, inside`, the hashes of runs of each page that are boilerplate of its host out of articles, and in them."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for page, host, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = blocks(cell.as_py())
                keys.append(article_key(found, page))
                lists.append(kept_runs(stream(found), host).view(np.int64))
            ends = np.concatenate([[0], np.cumsum([*map(len, lists)])]).astype(np.int32)
            runs_of = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), runs_of], names=["page", "host", "article", "runs"])

    suffixes = written(rows.mapInArrow(parse, "page long, host long, article long, runs array<long>"), "pages-suffixes")
    each = suffixes.select("page", F.explode("runs").alias("run"))
    more = written(each.groupBy("run").count().filter(F.col("count") >= LEAST_PAGES).select("run"), "pages-repeated")
    of_page = written(suffixes.select("page", "host", "article").distinct(), "pages-articles")
    repeats = written(each.join(more.hint("merge"), "run"), "pages-repeats")  # one plan at every size
    forget(suffixes, more)
    hosts = of_page.groupBy("host").agg(F.count_distinct("article").alias("articles"))
    often = repeats.join(of_page, "page").groupBy("host", "run").agg(F.count_distinct("article").alias("n")).join(hosts, "host")
    often = often.filter((F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("articles")))
    often = often.select("run", ((F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("articles"))).alias("strong"))
    hits = repeats.join(often, "run").groupBy("page")
    out = written(hits.agg(F.collect_set("run").alias("outside"), F.collect_set(F.when(F.col("strong"), F.col("run"))).alias("inside")), "pages-boilerplate")
    forget(repeats, of_page)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id, url, text, n_chars` for each row of `pages`."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, cell, outside, inside in zip(batch.column(5).to_pylist(), *batch.columns[2:5], strict=True):
                known = [r.values.to_numpy().view(np.uint64) if r.is_valid else NOTHING for r in (outside, inside)]
                texts.append(main_text(blocks(cell.as_py()), host, *known))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.xxhash64(page_id, url, html).alias("page"), F.xxhash64(host).alias("host"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    marked = rows.join(boilerplate(rows.select("page", "host", "html")), "page", "left")
    return marked.select("page_id", "url", "html", "outside", "inside", "host").mapInArrow(judge, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
