"""Pictures of books as a binary column: pixels of any kind to RGB on white, files, and their place among a page's paragraphs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookflow.functions.text import escape_xml

#: Samples of a pixel by kind (`bit` has eight pixels a byte, rows padded); the least width and height of a picture.
KINDS = {"bit": 1, "grey": 1, "rgb": 3, "rgba": 4, "cmyk": 4}
LEAST_SIDE = 25


def _samples(data: bytes, size: int, fill: int = 0) -> np.ndarray:
    """The first `size` bytes; what is missing is `fill`."""
    own = np.frombuffer(data, np.uint8, min(size, len(data)))
    return own if len(own) == size else np.concatenate([own, np.full(size - len(own), fill, np.uint8)])


def to_rgb(kind: str, width: int, height: int, data: bytes) -> np.ndarray:
    """Rows, columns, and red, green and blue. Alpha is blended with white; where all of it is zero there is none; missing samples are 0, and opaque."""
    if kind == "bit":
        stride = -(-width // 8)
        bits = np.unpackbits(_samples(data, stride * height).reshape(height, stride), axis=1)[:, :width]
        return np.repeat(bits[:, :, None] * np.uint8(255), 3, axis=2)
    deep = KINDS[kind]
    pixels = _samples(data, width * height * deep).reshape(height, width, deep)
    if kind == "grey":
        return np.repeat(pixels, 3, axis=2)
    if kind == "rgb":
        return pixels
    colour, last = pixels[:, :, :3].astype(np.float64), pixels[:, :, 3:].astype(np.float64) / 255
    if kind == "cmyk":
        return np.floor((255 - colour) * (1 - last) + 0.5).astype(np.uint8)
    alpha = pixels[:, :, 3].copy()
    alpha.ravel()[len(data) // 4 :] = 255
    if not alpha.any():
        return pixels[:, :, :3]
    share = alpha[:, :, None] / 255
    return np.floor(colour * share + 255 * (1 - share) + 0.5).astype(np.uint8)


def bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed picture file, 24 bits a pixel, rows from the top and padded to four bytes."""
    high, wide, _ = pixels.shape
    rows = np.zeros((high, -(-3 * wide // 4) * 4), np.uint8)
    rows[:, : 3 * wide] = pixels[:, :, ::-1].reshape(high, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, wide, -high, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def converted(pictures: DataFrame) -> DataFrame:
    """`book, page, place, width, height, file, error` of the pictures `book, page, place, kind, width, height, data` that are large enough. One of an unknown kind or without data keeps its row, with what is wrong with it."""
    names = ["book", "page", "place", "width", "height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index
            files, errors = [], []
            for kind, width, height, data in zip(*(batch.column(at(c)).to_pylist() for c in ("kind", "width", "height")), batch.column(at("data")), strict=True):
                if kind in KINDS and data.is_valid:
                    files.append(bmp(to_rgb(kind, width, height, data.as_py())))
                    errors.append(None)
                else:
                    files.append(None)
                    errors.append(f"no pixels of a known kind: {kind}")
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in names), pa.array(files, pa.binary()), pa.array(errors, pa.string())], names=[*names, "file", "error"])

    large = pictures.filter((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE))
    kinds = dict(pictures.dtypes)
    return large.select(*names, "kind", "data").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", file binary, error string")


def with_pictures(paragraphs: DataFrame, pictures: DataFrame) -> DataFrame:
    """`book, page, ord, kind, text, href`: a page's paragraphs and notes, and after them its pictures as figures."""
    href = F.concat(F.lit("images/page-"), F.col("page").cast("string"), F.lit("-"), F.col("place").cast("string"), F.lit(".bmp"))
    figure = F.concat(F.lit('<figure><img src="'), escape_xml(href), F.lit('" alt="'), F.col("page").cast("string"), F.lit('"/></figure>'))
    shown = pictures.filter("file IS NOT NULL").select("book", "page", F.col("place").alias("ord"), F.lit("picture").alias("kind"), figure.alias("text"), href.alias("href"))
    both = paragraphs.select("book", "page", "ord", "kind", "text", F.lit(None).cast("string").alias("href")).unionByName(shown)
    order = W.partitionBy("book", "page").orderBy(F.col("kind") == "picture", "ord")
    return both.withColumn("ord", (F.row_number().over(order) - 1).cast("int"))


def book_counts(every: DataFrame) -> DataFrame:
    """`book, notes, pictures` of what `with_pictures` gives: null where a book has none."""
    count = lambda kind: F.nullif(F.count_if(F.col("kind") == kind), F.lit(0))
    return every.groupBy("book").agg(count("note").alias("notes"), count("picture").alias("pictures"))
