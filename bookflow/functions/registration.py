"""Names for SQL: scalar functions as SQL expressions, the diff as an Arrow function, blocks as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bookflow.functions.diff import _batches
from bookflow.functions.text import WS
from bookflow.sources.html_blocks import tree_blocks


class ExtractBlocks:
    """`block_no, tag, text, status` of one page."""

    def eval(self, html: str) -> Iterator[tuple]:
        for k, block in enumerate(tree_blocks(html)):
            yield (k, *block)


def register(spark: SparkSession) -> None:
    """`extract_blocks(html)` as a table function, `text_diff(a, b)`, and `strip_tags`, `decode_entities`, `count_words` as SQL expressions that the optimizer sees through."""
    spark.udtf.register("extract_blocks", F.udtf(ExtractBlocks, returnType="block_no: int, tag: string, text: string, status: string"))
    spark.udf.register("text_diff", F.arrow_udf(_batches, "struct<diffs:array<struct<type:string,value:string>>,fixed_words:int>"))
    space = WS.replace("\\", "\\\\")
    bodies = {
        "strip_tags": "regexp_replace(t, '<[^>]*>', '')",
        "decode_entities": "replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"')",
        "count_words": f"coalesce(cast(size(filter(split(t, '{space}+'), w -> w <> '')) as bigint), 0L)",
    }
    for name, body in bodies.items():
        kind = "BIGINT" if name == "count_words" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
