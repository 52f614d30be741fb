"""Operator 7: media columns, as Netpbm or BMP files in a binary column.

`encode_media` stores rows of bytes as an 8-bit picture, `read_media` decodes a
column of pictures to numpy arrays, shrinks each by area through an integral
image, and returns an NPY tile and a difference hash. Both are narrow maps over
Arrow batches: no row meets another, so no key can be hot. Of the integral image
only the rows that the small picture needs are kept, so a very long picture
costs a few rows of sums and not eight times its size.

Defined cases: a null text is an empty one, stored as one block of zeros; equal
texts give equal bytes, hashes and features; repeated rows stay; an empty table
gives an empty one; a null picture, or bytes that are no picture of these kinds,
gives null fields; other columns of the input aren't carried.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import table

#: The payload is padded to a multiple of this, which is also the width of the stored picture.
BLOCK = 64
#: Bytes of pictures in one Arrow batch that goes back to Spark.
BATCH_BYTES = 16 << 20
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (rows, columns) or (rows, columns, 3); samples of up to 8 bits as uint8, else uint16. P1 and P4 are 0 for black and 1 for white."""
    kind, at, header = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("a Netpbm header is cut short")
        header.append(int(m[1]))
        at = m.end()
    wide, high, top = header[0], header[1], header[2] if len(header) > 2 else 1
    if kind == b"P4":
        stride = (wide + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * high, at + 1).reshape(high, stride)
        return 1 - np.unpackbits(rows, axis=1)[:, :wide]
    if kind == b"P1":
        bits = re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[: wide * high]
        return (1 - (np.frombuffer(bits, np.uint8) - 48)).reshape(high, wide)
    shape = (high, wide, 3) if kind in (b"P3", b"P6") else (high, wide)
    if kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[: int(np.prod(shape))], np.int64)
        return flat.reshape(shape).astype(np.uint8 if top < 256 else np.uint16)
    if kind not in (b"P5", b"P6"):
        raise ValueError("not a Netpbm picture")
    return np.frombuffer(data, np.uint8 if top < 256 else ">u2", int(np.prod(shape)), at + 1).reshape(shape)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey with a palette, or 24-bit colour; rows from the bottom, padded to four bytes."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    high, wide, deep = pixels.shape[0], pixels.shape[1], 8 if pixels.ndim == 2 else 24
    flat = pixels.reshape(high, -1) if deep == 8 else pixels[:, :, ::-1].reshape(high, -1)
    rows = np.zeros((high, (flat.shape[1] + 3) // 4 * 4), np.uint8)
    rows[:, : flat.shape[1]] = flat[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if deep == 8 else np.zeros(0, np.uint8)
    start = 54 + palette.size
    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + rows.size, 0, 0, start, 40, wide, high, 1, deep, 0, rows.size, 2835, 2835, 256 if deep == 8 else 0, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits a pixel; grey palettes give (rows, columns), else (rows, columns, 3)."""
    start, _, wide, high, _, deep, packed = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    if data[:2] != b"BM" or deep not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("not a BMP picture of 8, 24 or 32 bits")
    stride = (wide * deep // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(high), start).reshape(abs(high), stride)[:, : wide * deep // 8]
    rows = rows[::-1] if high > 0 else rows
    if deep == 8:
        palette = np.frombuffer(data, np.uint8, colours * 4, start - colours * 4).reshape(-1, 4)[:, 2::-1]
        if rows.size and rows.max() >= len(palette):
            raise ValueError("a pixel beyond the palette")
        grey = (palette == palette[:, :1]).all()
        return palette[:, 0][rows] if grey else palette[rows]
    return rows.reshape(abs(high), wide, deep // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _cuts(length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.linspace(0, length, parts + 1)
    whole = np.minimum(edge.astype(np.int64), length - 1)
    return whole, edge - whole


def area_resize(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Mean of the area under each new pixel. The integral image is linear between its points, so edges inside a pixel are exact too."""
    grid = pixels.reshape(pixels.shape[0], pixels.shape[1], -1)
    y, fy = _cuts(grid.shape[0], high)
    x, fx = _cuts(grid.shape[1], wide)
    rows = [np.zeros(grid.shape[1:], np.float64)]
    for a, b in zip(y, y[1:], strict=False):
        rows.append(rows[-1] + grid[a:b].sum(axis=0, dtype=np.float64))
    at_rows = np.stack(rows) + fy[:, None, None] * grid[y]
    sums = np.concatenate([np.zeros((high + 1, 1, grid.shape[2])), at_rows.cumsum(axis=1)], axis=1)
    table = sums[:, x] + fx[None, :, None] * (sums[:, x + 1] - sums[:, x])
    area = (grid.shape[0] / high) * (grid.shape[1] / wide)
    out = (table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]) / area
    return out.reshape(high, wide, *pixels.shape[2:])


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hexadecimal: of an 8 by 9 area-resized grey picture, whether each pixel is brighter than the one to its right."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = 16) -> bytes:
    """The picture area-resized to `side` by `side`, as an NPY file of uint8."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.floor(area_resize(pixels, side, side) + 0.5).clip(0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def encode_media(docs: DataFrame, doc_id: str = "doc_id", data: Column | None = None, text: str = "text", block: int = BLOCK, form: str = "pgm") -> DataFrame:
    """`doc_id, n_bytes, media`: the bytes of `data` (the UTF-8 of `text`), zero-padded to a positive multiple of `block`, as a grey picture `block` wide."""
    data = F.col(text).cast("binary") if data is None else data
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    store = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = cell.as_py() or b""
                padded = raw.ljust(max(block, -(-len(raw) // block) * block), b"\0")
                media = store(np.frombuffer(padded, np.uint8).reshape(-1, block))
                rows.append((key, len(raw), media))
                held += len(media)
                if held > BATCH_BYTES:
                    yield _sent(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _sent(rows, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), data.alias("data")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, tail: int = BLOCK) -> DataFrame:
    """From `doc_id, n_bytes, media`: the decoded samples' size, SHA-256 and the CRC-32 of their last `tail`, the stored form's size and SHA-256, `feature` (difference hash) and `tile` (NPY)."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in out.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = cell.as_py()
                try:
                    pixels = decode(data)
                    flat = pixels.tobytes()
                    rows.append((key, n, len(flat), hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-tail:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), npy_tile(pixels)))
                except (ValueError, TypeError, struct.error):
                    rows.append((key, n, *[None] * 7))
            if rows:
                yield _sent(rows, schema)

    return media.mapInArrow(run, out)


def op7_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_media(encode_media(docs)).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
