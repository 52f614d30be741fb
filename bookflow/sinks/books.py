"""Chapters and blocks back into books: HTML, EPUB and MOBI files in a binary column."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import BARE_AMPERSAND, escape_xml
from bookflow.sources.html_blocks import rebuilt

RECORD = 4096


def chapter_html(blocks: DataFrame) -> DataFrame:
    """`book, chapter_no, html`: a chapter's blocks in order, each in its element; blocks merged into another are left out. Keyed by ordinals, not by place."""
    shown = F.when(F.col("tag").isin("figure", "aside"), F.col("text")).otherwise(escape_xml(F.col("text")))
    element = F.concat(F.lit("<"), F.col("tag"), F.lit(">"), shown, F.lit("</"), F.col("tag"), F.lit(">"))
    kept = blocks.filter(~F.coalesce(F.col("is_merged"), F.lit(False))) if "is_merged" in blocks.columns else blocks
    parts = F.sort_array(F.collect_list(F.struct("block_no", element.alias("e"))))
    return kept.groupBy("book", "chapter_no").agg(F.array_join(F.transform(parts, lambda p: p["e"]), "\n").alias("html"))


def rebuilt_chapters(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """`book, chapter_no, html`: each chapter's own page with its blocks put back in place, from `book, chapter_no, html` and `book, chapter_no, block_no, tag, html, is_merged`. A chapter without blocks stays as it is."""
    parts = F.sort_array(F.collect_list(F.struct("block_no", "tag", F.col("html").alias("inner"), F.coalesce("is_merged", F.lit(False)).alias("gone"))))
    listed = blocks.groupBy("book", "chapter_no").agg(parts.alias("parts"))

    @F.pandas_udf("string")
    def put_back(html: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([h if p is None or h is None else rebuilt(h, [(b["tag"], b["inner"], b["gone"]) for b in p]) for h, p in zip(html, parts, strict=True)])

    return chapters.join(listed, ["book", "chapter_no"], "left").select("book", "chapter_no", put_back("html", "parts").alias("html"))


def epub_files(title: str, creator: str | None, language: str, identifier: str, chapters: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Names and texts of an EPUB's files, the type first. A bare ampersand of a page is written as a reference, as XML wants it: a cut `&amp` stays the text that it was."""
    names = [f"chapter_{k + 1:03}.xhtml" for k in range(len(chapters))]
    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(head)}</title></head><body>{body}</body></html>'
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
    points = "".join(f'<navPoint id="n{k}" playOrder="{k + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for k, (n, (t, _)) in enumerate(zip(names, chapters, strict=True)))
    links = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    by = f"<dc:creator>{escape(creator)}</dc:creator>" if creator else ""
    return [
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title>{by}<dc:language>{escape(language)}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{refs}</spine></package>'),
        ("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'),
        ("OEBPS/nav.xhtml", page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>')),
        *((f"OEBPS/{n}", page(t, re.sub(BARE_AMPERSAND, "&amp;", h))) for n, (t, h) in zip(names, chapters, strict=True)),
    ]


def epub_bytes(files: list[tuple[str, str]]) -> bytes:
    """The archive: the type stored as it is, everything else deflated; fixed times, so equal books are equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(info, text.encode(), compresslevel=9)
    return out.getvalue()


def mobi_bytes(title: str, creator: str | None, html: str) -> bytes:
    """A PalmDB file: header record with EXTH, uncompressed text records of RECORD bytes, and the closing records."""
    data = html.encode()
    texts = [data[k : k + RECORD] for k in range(0, len(data), RECORD)] or [b""]
    known = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in ((100, (creator or "").encode()), (503, title.encode())) if v)
    exth = b"EXTH" + struct.pack(">II", 12 + len(known), 2 if creator else 1) + known
    exth += b"\0" * (-len(exth) % 4)
    mobi = bytearray(b"MOBI" + struct.pack(">IIII", 232, 2, 65001, 0) + b"\xff" * 40 + b"\0" * 172)
    struct.pack_into(">I", mobi, 0x70, 0x40)
    first = struct.pack(">HHIHHHH", 1, 0, len(data), len(texts), RECORD, 0, 0) + bytes(mobi) + exth + title.encode()
    records = [first, *texts, b"FLIS\0\0\0\x08", b"FCIS\0\0\0\x14", b"\xe9\x8e\r\n"]
    at, table = 78 + 8 * len(records) + 2, b""
    for k, r in enumerate(records):
        table += struct.pack(">II", at, 2 * k)
        at += len(r)
    name = title.encode()[:31].decode("utf-8", "ignore").encode().ljust(32, b"\0")
    head = name + struct.pack(">HHIIIIII", 0, 0, 0, 0, 0, 0, 0, 0) + b"BOOKMOBI" + struct.pack(">IIH", 2 * len(records), 0, len(records))
    return head + table + b"\0\0" + b"".join(records)


def packaged(chapters: DataFrame, form: str = "epub") -> DataFrame:
    """`book, file` from `book, title, creator, chapter_no, chapter_title, html`; one book is one group."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("chapter_no")
        title, creator = rows["title"].iloc[0], rows["creator"].iloc[0]
        parts = list(zip(rows["chapter_title"], rows["html"], strict=True))
        if form == "epub":
            file = epub_bytes(epub_files(title, creator, "tr", str(key[0]), parts))
        else:
            file = mobi_bytes(title, creator, "".join(f"<mbp:pagebreak/><h2>{escape(t)}</h2>{h}" for t, h in parts))
        return pd.DataFrame({"book": [key[0]], "file": [file]})

    return chapters.groupBy("book").applyInPandas(pack, "book string, file binary")
