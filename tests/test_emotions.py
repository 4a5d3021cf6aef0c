"""Scores, counts and features of hand-derived texts."""

import pytest

from moodweave.functions.domains import FEATURE_ORDER, fallback_lexicon
from moodweave.operators import emotions


@pytest.mark.parametrize(
    "text, counts, scores",
    [
        ("happy and excited", {"joy": 2}, {"joy": 2.0}),
        ("not happy", {}, {"sadness": 0.5, "joy": 0.1}),
        ("never sure", {}, {"anger": 0.5, "trust": 0.1}),
        ("not disgusted", {}, {"trust": 0.5, "disgust": 0.1}),
        ("not afraid now but i still remain happy", {"joy": 1}, {"anticipation": 0.5, "fear": 0.1, "joy": 1.0}),
        ("", {}, {}),
        (None, {}, {}),
    ],
)
def test_features(spark, text, counts, scores):
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    row = emotions.lexicon_features(docs, fallback_lexicon(spark)).first().asDict()
    assert {e: row[f"count_{e}"] for e in FEATURE_ORDER if row[f"count_{e}"]} == counts
    assert {e: row[f"intensity_{e}"] for e in FEATURE_ORDER if row[f"intensity_{e}"]} == scores
    assert list(row)[1:] == list(emotions.FEATURES)


def test_compatible_width_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    out = emotions.lexicon_features(docs, fallback_lexicon(spark), compatible=True)
    assert out.columns[1:] == list(emotions.FEATURES[:21])
    assert out.count() == 0


def test_fitted_width(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    row = rows.select(emotions.fitted_width(F.col("x"), 2).alias("a"), emotions.fitted_width(F.col("x"), 4).alias("b")).first()
    assert (row["a"], row["b"]) == ([1.0, 2.0], [1.0, 2.0, 3.0, 0.0])
