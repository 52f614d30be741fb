"""EPUB books as tables: entries of the archive, manifest, spine, metadata, chapters, blocks."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.sources.html_blocks import blocks_by_tree, page_title

_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """`book, content` of the files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), "content")


def entries(books: DataFrame) -> DataFrame:
    """`book, path, content, error` of every entry of each archive. One book is one row, and its entries leave one at a time; a file that is no archive leaves one row, with what is wrong with it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in zip(frame["book"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        names = archive.namelist()
                        if not names:
                            raise zipfile.BadZipFile("the archive is empty")
                        for name in names:
                            yield pd.DataFrame({"book": [book], "path": [name], "content": [archive.read(name)], "error": [None]})
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError) as error:
                    yield pd.DataFrame({"book": [book], "path": [None], "content": [None], "error": [str(error)]})

    return books.select("book", "content").mapInPandas(run, "book string, path string, content binary, error string")


def resolve(base: str, relative: str) -> str:
    """A path relative to a folder, without `.` and `..`."""
    return posixpath.normpath(posixpath.join(base, unquote(relative))).lstrip("/")


def packages(all_entries: DataFrame) -> DataFrame:
    """`book, title, creator, language, identifier, publisher, manifest, spine, error` from each book's container and package files.

    The small files alone are grouped by book; a book without container, path or package keeps its row, with what it lacks.
    """

    def read(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return package_of(key, frame)
        except (ValueError, ElementTree.ParseError) as error:
            return pd.DataFrame({"book": [key[0]], **{c: [None] for c in ("title", "creator", "language", "identifier", "publisher", "manifest", "spine")}, "error": [str(error)]})

    def package_of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(frame["path"], frame["content"], strict=True))
        if None in held:
            raise ValueError(frame["error"].iloc[0])
        if "META-INF/container.xml" not in held:
            raise ValueError(f"{key[0]}: no META-INF/container.xml")
        root = ElementTree.fromstring(held["META-INF/container.xml"]).find(".//c:rootfile", _NS)
        where = root.get("full-path") if root is not None else None
        if not where or where not in held:
            raise ValueError(f"{key[0]}: no package file")
        package, base = ElementTree.fromstring(held[where]), posixpath.dirname(where)
        text = lambda name: next((e.text.strip() for e in package.iterfind(f".//d:{name}", _NS) if e.text and e.text.strip()), None)
        manifest = [{"id": e.get("id"), "href": resolve(base, e.get("href", "")), "media_type": e.get("media-type", "")} for e in package.iterfind(".//o:manifest/o:item", _NS)]
        spine = [e.get("idref") for e in package.iterfind(".//o:spine/o:itemref", _NS)]
        return pd.DataFrame({"book": [key[0]], "title": [text("title") or "Başlıksız Kitap"], "creator": [text("creator")], "language": [text("language") or "tr"], "identifier": [text("identifier")], "publisher": [text("publisher")], "manifest": [manifest], "spine": [spine], "error": [None]})

    is_small = F.coalesce(F.col("path").isin("META-INF/container.xml") | F.col("path").endswith(".opf"), F.lit(True))
    small = all_entries.withColumn("content", F.when(is_small, F.col("content"))).withColumn("rank", F.when(is_small, 0).otherwise(1))
    least = small.groupBy("book").agg(F.min("rank").alias("least"), F.first("path").alias("any"))
    small = small.filter("rank = 0").drop("rank").unionByName(least.filter("least = 1").select("book", F.col("any").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error")))
    return small.groupBy("book").applyInPandas(read, "book string, title string, creator string, language string, identifier string, publisher string, manifest array<struct<id:string,href:string,media_type:string>>, spine array<string>, error string")


def _decoded(contents: pd.Series, names: pd.Series) -> pd.Series:
    """Contents by the names of their encodings, or UTF-8 where nobody knows the name; what isn't valid is replaced."""

    def one(content: bytes | None, name: str) -> str | None:
        try:
            return None if content is None else content.decode(name, "replace")
        except LookupError:
            return content.decode("utf-8", "replace")

    return pd.Series([one(c, n) for c, n in zip(contents, names, strict=True)], dtype=object)


def decoded(content: Column) -> tuple[Column, Column]:
    """The text of a page, and what is wrong with it. The encoding is the one that its mark or its first bytes declare; UTF-8, as nearly all are, is decoded in the JVM."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"(?i)(?:encoding|charset)\s*=\s*[\"']?([a-z0-9_.:-]+)", 1))
    name = F.when(head.rlike("^(?:\u00fe\u00ff|\u00ff\u00fe)"), "utf-16").when(head.rlike("^\u00ef\u00bb\u00bf"), "utf-8").otherwise(declared)
    plain = name.isin("", "utf-8", "utf8", "us-ascii", "ascii")
    text = content.cast("string")
    error = F.when(plain & ~F.is_valid_utf8(text), "not valid UTF-8: replaced")
    return F.when(plain, F.make_valid_utf8(text)).otherwise(F.pandas_udf(_decoded, "string")(F.when(~plain, content), name)), error


def chapters(all_entries: DataFrame, books: DataFrame) -> DataFrame:
    """`book, chapter_no, href, html, error, title`: the spine joined to the manifest (the last entry of an id counts) and to the archive; what isn't there or isn't text drops out. A page in no valid encoding stays, with its bad bytes replaced and its error."""
    manifest = books.select("book", F.posexplode("manifest").alias("at", "m")).groupBy("book", F.col("m.id").alias("id")).agg(F.max_by("m", "at").alias("m"))
    spine = books.select("book", F.posexplode("spine").alias("chapter_no", "id"))
    joined = spine.join(manifest, ["book", "id"]).filter(F.col("m.media_type").rlike("html|xml")).select("book", "chapter_no", F.col("m.href").alias("path"))
    html, error = decoded(F.col("content"))
    found = joined.join(all_entries.drop("error"), ["book", "path"]).select("book", "chapter_no", F.col("path").alias("href"), html.alias("html"), error.alias("error"))
    title = page_title(F.col("html"))
    return found.withColumn("title", F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Bölüm "), (F.col("chapter_no") + 1).cast("string"))))


def blocks(book_chapters: DataFrame, whole: bool = False) -> DataFrame:
    """`book, chapter_no, block_no, tag, text, status` of all chapters; `whole` as in `tree_blocks`."""
    keyed = book_chapters.select(F.to_json(F.struct("book", "chapter_no")).alias("key"), "html")
    key = F.from_json("key", "book string, chapter_no int")
    return blocks_by_tree(keyed, "key", "html", whole).select(key["book"].alias("book"), key["chapter_no"].alias("chapter_no"), "block_no", "tag", "text", "status")
