"""Projections around a run."""

import pytest
from pyspark.sql import functions as F

from bookflow.functions import settings


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_glossary(spark):
    base = F.create_map(F.lit("a"), F.lit("1"))
    assert value(spark, settings.glossary_with(base, F.lit(" a "), F.lit(" 2 "))) == {"a": "2"}
    assert value(spark, settings.glossary_with(base, F.lit("b"), F.lit("3"))) == {"a": "1", "b": "3"}
    assert value(spark, settings.glossary_with(base, F.lit("b"), F.lit(" "))) == {"a": "1"}
    assert value(spark, settings.glossary_without(base, F.lit("a"))) == {}


@pytest.mark.parametrize("done,total,want", [(1, 3, 33), (1, 8, 13), (9, 3, 100), (0, 0, 0)])
def test_progress(spark, done, total, want):
    assert value(spark, settings.progress(F.lit(done), F.lit(total))) == want


def test_seconds_left(spark):
    assert value(spark, settings.seconds_left(F.lit(2), F.lit(6), F.lit(5))) == 10 and value(spark, settings.seconds_left(F.lit(0), F.lit(6), F.lit(5))) is None


def test_providers(spark):
    urls = {"https://OpenRouter.ai/x": "openrouter", "https://api.groq.com/openai": "groq", "http://localhost:1234": "local", "https://x.example": "custom"}
    assert all(value(spark, settings.provider(F.lit(u))) == p for u, p in urls.items())
    assert value(spark, settings.provider_ready(F.lit("groq"), F.lit(" "), F.lit(False))) is False and value(spark, settings.provider_ready(F.lit("local"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))) is True


def test_models_fall_back(spark):
    none = spark.createDataFrame([("f", "F", 1)], "id string, name string, context_length int")
    rows = spark.createDataFrame([('{"id":"a:free","name":"A","context_length":5}',), ("{bad",), ('{"id":"b","pricing":{"prompt":"0","completion":"0"}}',), ('{"id":"c","pricing":{"prompt":"1","completion":"0"}}',)], "j string")
    assert sorted(r.id for r in settings.free_models(rows, "j", none).collect()) == ["a:free", "b"]
    assert [r.id for r in settings.free_models(rows.filter("j like '{bad%'"), "j", none).collect()] == ["f"]


def test_metadata_and_reset(spark):
    m = value(spark, settings.book_metadata(F.lit(" "), F.lit(None).cast("string"), F.lit("Maker"), F.lit("A book.PDF")))
    assert tuple(m) == ("A book", "Maker", "tr")
    row = settings.reset(spark.createDataFrame([("a", "b", "completed", 4)], "original_text string, corrected_text string, status string, diff_count int")).first()
    assert tuple(row) == ("a", "a", "pending", 0)
