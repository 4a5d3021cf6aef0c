"""Stateless affect operators over streams: each row holds a whole text, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import predict
from ..operators.emotions import prepare


def tokens_and_style(stream: DataFrame, cues=None) -> DataFrame:
    """A stream of (doc_id, text, lang) with tokens, negated positions and style columns."""
    return prepare(stream, cues).select("*", *[c.alias(k) for k, c in T.style(F.col("text")).items()])


def flipped_predictions(stream: DataFrame, cues) -> DataFrame:
    """A stream of (text, prediction[, probabilities]) after the negation flip."""
    return predict.with_flip(stream, cues)


def windowed_labels(stream: DataFrame, time: str, width: str, lateness: str, label: str = "label") -> DataFrame:
    """Rows per label and time window, with late rows up to ``lateness``."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), label).agg(F.count("*").alias("n"))
