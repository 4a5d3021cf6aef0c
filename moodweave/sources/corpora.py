"""Corpus readers: labelled texts in the form (text, label), with a read-through Parquet cache."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domains import PRIORITY_LABELS
from ..operators import labels
from .store import complete, delete, publish


def fine_corpus(raw: DataFrame, first_id_only: bool = True) -> DataFrame:
    """(text, labels: array of fine ids) to (text, label); rows without a target are dropped."""
    of = labels.first_fine if first_id_only else labels.first_mappable
    return raw.select("text", of(F.col("labels")).alias("label")).where("label IS NOT NULL")


def priority_corpus(raw: DataFrame, single: bool = True) -> DataFrame:
    """Boolean label columns, ``agreed_labels``, ``label`` and ``emotion``, as far as present, to (text, label)."""
    flags: dict[str, Column] = {p: F.col(p).cast("boolean") for p in PRIORITY_LABELS if p in raw.columns}
    agreed = F.col("agreed_labels") if "agreed_labels" in raw.columns else None
    names = [F.col(c) for c in ("label", "emotion") if c in raw.columns] if single else []
    label = labels.bilingual_target(labels.priority_label(flags, agreed, *names))
    return raw.where(F.trim("text") != "").select("text", label.alias("label")).where("label IS NOT NULL")


def sniffed(raw: DataFrame) -> DataFrame | None:
    """(text, label) from the first columns whose names hint at them; None if there are none."""
    hint = lambda words: next((c for c in raw.columns if any(w in c.lower() for w in words)), None)
    text, label = hint(("text", "sentence", "tweet")), hint(("label", "emotion"))
    if text is None or label is None:
        return None
    out = raw.select(F.col(text).alias("text"), labels.bilingual_target(F.col(label)).alias("label"))
    return labels.usable(out)


def _labelled(spark: SparkSession, path: str) -> DataFrame | None:
    """The labelled texts of one CSV file; None if it can't be read or its header doesn't fit."""
    try:
        return sniffed(spark.read.option("header", True).csv(path))
    except PySparkException:
        return None


def read_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of CSV files that can be read and whose headers fit; ``FileNotFoundError`` if none does."""
    found = [f for f in (_labelled(spark, p) for p in paths) if f is not None]
    if not found:
        raise FileNotFoundError(f"no labelled CSV among {paths}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``, made and published first unless it is there as a whole."""
    if not complete(spark, path):
        publish(make(), path)
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str, sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, str]:
    """A corpus from the cache at ``path``, else from the first source that can be read, which is then cached; and which it was.

    A source fails if it can't be opened, doesn't fit, breaks off while it is read, or holds no labelled text; then the next one is tried.
    ``FileNotFoundError`` with all reasons if none is left.
    """
    if complete(spark, path):
        return spark.read.parquet(path), "cache"
    reasons = []
    for name, open_ in sources.items():
        try:
            # All of it is read here, so that a bad part later in the source counts as well.
            publish(labels.usable(open_()), path)
        except (PySparkException, Py4JJavaError, OSError, ValueError) as error:
            reasons.append(f"{name}: {str(error).splitlines()[0] if str(error) else type(error).__name__}")
            continue
        if not (made := spark.read.parquet(path)).isEmpty():
            return made, name
        delete(spark, path)
        reasons.append(f"{name}: no labelled text")
    raise FileNotFoundError("; ".join(reasons) or "no source")
