"""Blocks of HTML chapters: by pattern in the JVM, or from a tree of elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import WS, decode_entities, strip_tags, trimmed

# Elements that are blocks, that hold blocks, and that aren't text.
PRIMARY = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote dd dt figure aside".split())
CONTAINERS = frozenset("div section article".split())
NO_TEXT = frozenset("pre code math svg".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = r"(?is)(<(p|h1|h2|h3|h4|h5|h6|li|blockquote)[^>]*>(.*?)</\2>)"


def blocks_by_pattern(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """`keys, block_no, tag, html, text`: elements found by one pattern, blank ones dropped. There is no boundary after the name, as in the rule's home, so `pre` matches as `p`."""
    whole = F.regexp_extract_all(F.col(html), F.lit(BLOCK), 1)
    tags = F.regexp_extract_all(F.col(html), F.lit(BLOCK), 2)
    each = pages.select(*keys, F.posexplode(F.arrays_zip(whole.alias("w"), tags.alias("t"))).alias("at", "e"))
    text = trimmed(decode_entities(strip_tags(F.col("e.w"))))
    found = each.select(*keys, "at", F.lower("e.t").alias("tag"), F.col("e.w").alias("html"), text.alias("text")).filter("text <> ''")
    from pyspark.sql import Window as W

    return found.withColumn("block_no", (F.row_number().over(W.partitionBy(*keys).orderBy("at")) - 1).cast("int")).drop("at")


def page_title(html: Column) -> Column:
    """The title element's text, or else the first h1 to h3's."""
    pick = lambda p, g: trimmed(F.regexp_replace(decode_entities(strip_tags(F.regexp_extract(html, p, g))), f"{WS}+", " "))
    title = pick(r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(title != "", title).otherwise(pick(r"(?is)<h([1-3])[^>]*>(.*?)</h\1>", 2))


class _Tree(HTMLParser):
    """Elements as lists [tag, attributes, parent, children]; a text is a str."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = ["", {}, None, []]

    def handle_starttag(self, tag, attrs):
        if tag in PRIMARY | CONTAINERS:
            open_p = self.at
            while open_p and open_p[0] not in ("p", *CONTAINERS, ""):
                open_p = open_p[2]
            if open_p and open_p[0] == "p":
                self.at = open_p[2]
        node = [tag, dict(attrs), self.at, []]
        self.at[3].append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node[0] != tag:
            node = node[2]
        if node and node[2]:
            self.at = node[2]

    def handle_data(self, data):
        self.at[3].append(data)


def _inside(root) -> dict[int, set[str]]:
    """The names of all elements inside each element, by its identity. No recursion, as pages nest as deep as they like."""
    order, due = [], [root]
    while due:
        node = due.pop()
        order.append(node)
        due += [c for c in node[3] if isinstance(c, list)]
    names: dict[int, set[str]] = {}
    for node in reversed(order):
        own = names[id(node)] = set()
        for c in node[3]:
            if isinstance(c, list):
                own.add(c[0])
                own |= names[id(c)]
    return names


def _text(node) -> str:
    parts, due = [], [node]
    while due:
        one = due.pop()
        if isinstance(one, str):
            parts.append(one)
        else:
            due += reversed(one[3])
    return "".join(parts)


def tree_blocks(html: str | None, whole: bool = False) -> list[tuple[str, str, str]]:
    """`tag, text, status` of a chapter's blocks: primary elements that are in no other, and containers that hold neither kind. Figures and asides are done as they are. With `whole`, texts of under two characters count too, and texts keep their white space."""
    tree = _Tree()
    tree.feed(html or "")
    return [("figure", "[Görsel]", "completed") if node[0] == "figure" else (node[0], text, "completed" if node[0] == "aside" else "pending") for node, text in block_nodes(tree.root, whole)]


def block_nodes(root: list, whole: bool = False) -> list[tuple[list, str]]:
    """The elements that are blocks, in order, with their text."""
    out, inside, due = [], _inside(root), [root]
    while due:
        node = due.pop()
        inner = inside[id(node)]
        if node is not root and (node[0] in PRIMARY or node[0] in CONTAINERS and not inner & (PRIMARY | CONTAINERS)):
            text = _text(node) if whole else " ".join(_text(node).split())
            if node[0] in ("figure", "aside") or not inner & NO_TEXT and (whole or len(text) >= 2):
                out.append((node, text))
        else:
            due += [c for c in reversed(node[3]) if isinstance(c, list) and c[0] not in ("head", "script", "style")]
    return out


class _Placed(_Tree):
    """The tree, with the places in the source at which each element begins, its inside begins and ends, and it ends."""

    def __init__(self, html: str):
        super().__init__()
        self.lines, self.places, self.html = [0, *(m.end() for m in re.finditer("\n", html))], {}, html
        self.feed(html)
        self.close()
        self._shut(self.at, self.root, len(html), len(html))

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, node: list, upto: list, inner: int, end: int) -> None:
        """Ends `node` and its parents below `upto`; the last of them at `end`."""
        while node is not upto:
            last = node[2] is upto
            self.places[id(node)][2:] = [inner, end if last else inner]
            node = node[2]

    def handle_starttag(self, tag, attrs):
        before, here = self.at, self._here()
        super().handle_starttag(tag, attrs)
        node = self.at if tag not in _VOID else self.at[3][-1]
        inner = here + len(self.get_starttag_text())
        self.places[id(node)] = [here, inner, inner, inner]
        self._shut(before, node[2], here, here)

    def handle_endtag(self, tag):
        before, here = self.at, self._here()
        super().handle_endtag(tag)
        if self.at is not before:
            self._shut(before, self.at, here, self.html.find(">", here) + 1 or len(self.html))


def rebuilt(html: str, blocks: list[tuple[str, str | None, bool]]) -> str:
    """`html` with each of its blocks given back, in order, as `tag, inner, is_merged`: merged ones are gone, figures stay, a null inside stays, all around them is as it was."""
    tree = _Placed(html)
    out, done = [], 0
    for (node, _), (tag, inner, is_merged) in zip(block_nodes(tree.root), blocks, strict=False):
        start, begin, stop, end = tree.places[id(node)]
        if node[0] == tag == "figure" and not is_merged:
            continue
        inside = html[begin:stop] if inner is None else inner
        out += [html[done:start], "" if is_merged else html[start:begin] + inside + html[stop:end] if tag == node[0] else f"<{tag}>{inside}</{tag}>"]
        done = end
    return "".join([*out, html[done:]])


def blocks_by_tree(pages: DataFrame, key: str, html: str, whole: bool = False) -> DataFrame:
    """`key, block_no, tag, text, status` for each block of each page; `whole` as in `tree_blocks`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *b) for k, page in zip(frame[key], frame[html], strict=True) for i, b in enumerate(tree_blocks(page, whole))]
            yield pd.DataFrame(rows, columns=[key, "block_no", "tag", "text", "status"])

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, block_no int, tag string, text string, status string")
