"""What a model answered for one block: its tag, its inner markup and its text; and the texts of all routes as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import decode_entities, strip_tags, trimmed

# Block marks, and the tags that an answer may have.
_MARK = r"(?i)(?:\[/|</?|\[)(?:BLOCK|BLOK)[_\s]?[0-9]+[\]>]"
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li")
_WRAPPED = r"(?is)^<([a-z0-9]+)(?:\s+[^>]*)?>(.*?)</\1>\z"


def block_answer(raw: Column, default_tag: Column | str = "p") -> Column:
    """A struct of `tag, inner, text` from an answer: block marks go, one known element around all of it gives the tag. A null answer is empty."""
    clean = trimmed(F.regexp_replace(F.coalesce(raw, F.lit("")), _MARK, ""))
    tag = F.lower(F.regexp_extract(clean, _WRAPPED, 1))
    known = tag.isin(*BLOCK_TAGS)
    inner = F.when(known, trimmed(F.regexp_extract(clean, _WRAPPED, 2))).otherwise(clean)
    default = F.lit(default_tag) if isinstance(default_tag, str) else default_tag
    return F.struct(F.when(known, tag).otherwise(default).alias("tag"), inner.alias("inner"), trimmed(decode_entities(strip_tags(inner))).alias("text"))


def joined_routes(routed: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, route, text`: the cached, rule-cleaned, kept and answered blocks as one table again.

    `routed` has `route, original_text, corrected_text, cached_text`; `answers`
    has `corrected` for blocks of the route to the model. Figures keep what they
    have, merged blocks have no text.
    """
    both = routed.join(answers.select(*keys, F.col("corrected").alias("answer")), keys, "left")
    text = (
        F.when(F.col("route") == "skip", None).when(F.col("route") == "figure", F.col("original_text")).when(F.col("route") == "cache", F.col("cached_text"))
        .when(F.col("route") == "model", F.coalesce("answer", "corrected_text")).otherwise(F.col("corrected_text"))
    )
    return both.select(*keys, "route", text.alias("text"))
