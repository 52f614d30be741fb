"""White space, letters and Turkish casing as explicit classes, one place for all patterns.

Java's `\\s`, `\\b` and `(?i)` differ from those of the rules' home, so no pattern
here relies on them beyond ASCII.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: As Python's re takes it.
PLAIN_WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same for Java, which tries the parts of a class one by one: signs from ! to ~, nearly all there are, fail at the first.
WS = rf"[\x00-\x20\x7f-\x{{10ffff}}&&{PLAIN_WS}]"
LETTERS = "a-zA-ZçğıöşüÇĞİÖŞÜ"
LOWER, UPPER = "a-zçğıöşü", "A-ZÇĞİÖŞÜ"
#: Between words of ASCII word characters.
ASCII_BREAK = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: The characters of the class.
WS_SIGNS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_SIGNS))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "İI", "iı"))


def word_count(text: Column) -> Column:
    """Words between white space; 0 of a null."""
    return F.coalesce(F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != "")), F.lit(0)).cast("long")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def decode_entities(text: Column) -> Column:
    """Four character references, in this order, so `&amp;lt;` ends as `&lt;`."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def escape_xml(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


#: An ampersand that begins no character reference with its end.
BARE_AMPERSAND = "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)"


def round_half_up(number: Column) -> Column:
    """Halves go toward plus infinity."""
    return F.floor(number + 0.5)


def duration(seconds: Column) -> Column:
    """`m dk s sn`, or `s sn` under a minute; `0 sn` for a negative or missing number."""
    whole = F.floor(seconds).cast("long")
    minutes, rest = F.floor(whole / 60).cast("long"), whole % 60
    text = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" dk "), rest.cast("string"), F.lit(" sn"))).otherwise(F.concat(rest.cast("string"), F.lit(" sn")))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0), "0 sn").otherwise(text)


def file_size(n_bytes: Column) -> Column:
    """Megabytes with two decimals from one megabyte on, else whole kilobytes; halves go to the even number, as in C's printf. Divisions by powers of two are exact."""
    hundredths = F.rint(n_bytes * 100 / F.lit(1024.0 * 1024.0))
    return F.when(n_bytes >= 1024 * 1024, F.concat(F.format_string("%.2f", hundredths / 100), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.0f", F.rint(n_bytes / F.lit(1024.0))), F.lit(" KB")))


def output_name(file_name: Column, language: Column | None = None) -> Column:
    """The name of a repaired file, or of one translated to `language`."""
    stem = F.regexp_replace(file_name, r"\.[^.]+\z", "")
    return F.concat(stem, F.lit("_duzeltilmis")) if language is None else F.concat(stem, F.lit("_"), language, F.lit("_cevrilmis"))


def parser_of(path: Column) -> Column:
    """Which source reads a file, by its extension."""
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".mobi") | low.endswith(".azw3"), "mobi").otherwise("epub")


def chapter_href(number: Column) -> Column:
    return F.concat(F.lit("chapter_"), F.lpad(number.cast("string"), 3, "0"), F.lit(".xhtml"))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


@F.pandas_udf(StringType())
def _text_hash(texts: pd.Series) -> pd.Series:
    """32-bit hashes in hexadecimal: h * 33 xor code, from 5381. The texts of a batch are folded together, code by code, the longest first."""
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat, begins, sizes = np.concatenate([codes[k] for k in order]).astype(np.int64) if len(codes) else np.zeros(0, np.int64), np.cumsum(sizes[order]) - sizes[order], sizes[order]
    h = np.full(len(codes), 5381, np.int64)
    for k in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -k, side="left"))
        h[:live] = (h[:live] * 33 ^ flat[begins[:live] + k]) & 0xFFFFFFFF
    out = np.empty(len(codes), object)
    out[order] = [f"{x:x}" for x in h.tolist()]
    return pd.Series(out).where(texts.notna().to_numpy(), None)


def cache_key(model: Column, text: Column, prefix: str | None = None) -> Column:
    """`[prefix_]model_hash_length` of a text with white space collapsed; the hash is h * 33 xor code, 32 bits, from 5381."""
    norm = trimmed(F.regexp_replace(text, f"{WS}+", " "))
    parts = [F.coalesce(F.nullif(model, F.lit("")), F.lit("default")), _text_hash(norm), F.char_length(norm).cast("string")]
    return F.concat_ws("_", *([F.lit(prefix)] if prefix else []), *parts)
