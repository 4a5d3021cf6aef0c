"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Statistics of each text are transformed to be roughly normal and standardised. Each class has its
mean and a covariance shrunk towards the pooled one and the identity; a score is the logistic of
the difference of the Mahalanobis log-densities (with class shares), from Cholesky factors that
are computed once.

Defined results: null and empty texts have defined statistics and so a score; a label other than 0
or 1, or with a null doc_id, teaches nothing; a document that is labelled twice counts twice; if a
class has no rows all scores are 0.5; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, stage
from .quality_rules import SYMBOLS, count_of, let, split_lines, split_words

#: Shares of the pooled covariance and of the identity (in standardised units) in each class's.
POOLED, IDENTITY = 0.2, 0.05
THRESHOLD = 0.3
FOLDS = 5
FEATURES = 9


def statistics(text: Column) -> Column:
    """An array of ``FEATURES`` doubles for one text."""
    text = plain(text)
    count = lambda chars: count_of(text, chars).cast("double")
    chars = F.length(text).cast("double") + 1.0
    facts = lambda w: F.struct(
        F.size(w).cast("double").alias("n"),
        F.length(F.array_join(w, "")).cast("double").alias("chars"),
        F.size(F.array_distinct(w)).cast("double").alias("u"),
    )
    share = lambda x: F.log(x + 0.01)

    def all_of(s: Column) -> Column:
        n = s["n"] + 1.0
        return F.array(
            F.log(n),
            F.log(s["chars"] / n + 1.0),
            share(count(SYMBOLS) / n),
            share(count("!") / n),
            share(count(r"\p{Lu}") / chars),
            F.log(s["u"] + 1.0) / F.log(s["n"] + 2.0),
            let(split_lines(text), lambda a: share((F.size(a) - F.size(F.array_distinct(a))).cast("double") / (F.size(a) + 1.0))),
            share(count("0-9") / chars),
            share(count(".,;:?") / n),
        )

    return let(let(split_words(text), facts), all_of)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the two classes, and how to standardise."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [b - 0.5 * np.square((z - m) @ w.T).sum(axis=1) for m, w, b in zip(self.means, self.whiten, self.offset, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | None:
    """Learn from ``labelled`` (x: array of doubles, label: 0 or 1); None if a class has no rows.

    Counts, sums and sums of products, two rows in all, are what comes to the driver.
    """
    d, x = FEATURES, lambda i: F.col("x")[i]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in range(d)]]
    sums += [F.sum(x(i) * x(j)).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["label"]: r for r in labelled.groupBy("label").agg(*sums).collect()}
    if not {0, 1} <= set(found):
        return None
    n = np.array([found[c]["n"] for c in (0, 1)], dtype=float)
    first = np.array([[found[c][f"s{i}"] for i in range(d)] for c in (0, 1)])
    second = np.zeros((2, d, d))
    for c in (0, 1):
        for i, j in pairs:
            second[c, i, j] = second[c, j, i] = found[c][f"p{i}_{j}"]
    total, centre = n.sum(), first.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(second.sum(axis=0).diagonal() / total - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    mean = first / n[:, None]
    cov = second / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    means, cov = (mean - centre) / scale, cov / np.outer(scale, scale)
    within = (cov * (n / total)[:, None, None]).sum(axis=0)
    cov = (1 - pooled - identity) * cov + pooled * within + identity * np.eye(d)
    chol = np.linalg.cholesky(cov)
    offset = np.log(n / total) - np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(centre, scale, means, np.linalg.inv(chol), offset)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    facts = stage(docs.select("doc_id", statistics(F.col("text")).alias("x")))
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0))
    model = fit(facts.join(taught.select("doc_id", F.col(label).alias("label")), "doc_id"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if model is None or not len(x):
            return pd.Series(np.full(len(x), 0.5))
        return pd.Series(model.score(np.stack(x.to_numpy())))

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return facts.select("doc_id", held.alias("held_out"), score("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels)
