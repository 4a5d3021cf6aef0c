"""TF-IDF over word and character n-grams, in long form: a row per document and term.

Texts are put together by document before they become terms, which are many times their size: a document's terms are then counted
and scaled where they lie, as arrays (``grams``). Document frequencies are grouped by term; the vocabulary is cut by corpus frequency and
comes to the driver. ``fit`` and ``transform`` are apart, so a vocabulary fitted on training rows serves any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import grams


@dataclass(frozen=True)
class Settings:
    words: tuple[int, int] = (1, 2)
    chars: tuple[int, int] = (3, 5)
    max_words: int = 50_000
    max_chars: int = 25_000
    min_df: int = 1
    max_df: float = 1.0
    sublinear: bool = False


IMPROVED = Settings(words=(1, 3), chars=(3, 6), min_df=2, max_df=0.95, sublinear=True)


def term_counts(docs: DataFrame, kind: str, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf of the raw, lower-case text; ``kind``: word or char."""
    raw = T.plain(F.col(text))
    grams = T.ngrams(T.tokens(F.lower(raw)), *settings.words) if kind == "word" else T.char_ngrams(raw, *settings.chars)
    # A number that is asked for stays: the small texts would else end up in few tasks.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lying = docs.select(key, text).repartition(parts, key)
    return lying.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, limit: int, settings: Settings = Settings()) -> DataFrame:
    """term, df, ctf, idf of the ``limit`` most frequent terms within the document-frequency bounds; ties by term."""
    return most_frequent(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")), n_docs, limit, settings)


def most_frequent(terms: DataFrame, n_docs: int, limit: int, settings: Settings = Settings()) -> DataFrame:
    """``vocabulary`` of the totals (term, df, ctf) of all terms."""
    kept = terms.where((F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * n_docs))
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    # ORDER BY with LIMIT keeps a bounded heap per task.
    return kept.orderBy(F.desc("ctf"), "term").limit(limit).withColumn("idf", idf)


def weights(counts: DataFrame, vocabulary: DataFrame, settings: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """key, term, weight: tf times idf, each document scaled to length 1."""
    tf = (1.0 + F.log(F.col("tf"))) if settings.sublinear else F.col("tf").cast("double")
    raw = counts.join(F.broadcast(vocabulary.select("term", "idf")), "term").withColumn("w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def units(kind: str, text: str = "text") -> Column:
    """What n-grams of a text are made of: its words, or the text as its characters are counted."""
    raw = T.plain(F.col(text))
    return T.tokens(F.lower(raw)) if kind == "word" else T.squeezed(raw)


def _lying(docs: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """key and the units of all its texts, in as many tasks as a shuffle has."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(key, text).repartition(parts, key).groupBy(key).agg(F.collect_list(units(kind, text)).alias("texts"))


def totals(lying: DataFrame, kind: str, settings: Settings = Settings(), column: str = "texts") -> DataFrame:
    """term, df, ctf over documents, each an array of the units of its texts. Terms are counted by task before they are shuffled."""
    orders = settings.words if kind == "word" else settings.chars

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = grams.flat(batch.column(0))
            yield from grams.totals(kind, texts, rows, *orders)

    parts = lying.select(column).mapInArrow(of, "term string, df long, ctf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def learnt(docs: DataFrame, kind: str, settings: Settings = Settings(), n_docs: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``vocabulary`` of documents, without a row for each of their terms."""
    limit = settings.max_words if kind == "word" else settings.max_chars
    n = docs.count() if n_docs is None else n_docs
    return most_frequent(totals(_lying(docs, kind, key, text), kind, settings), n, limit, settings)


def tfidf(docs: DataFrame, kind: str, settings: Settings = Settings(), train: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Weights of ``docs`` under the vocabulary of ``train`` (of ``docs`` itself by default), which comes to the driver: ``weights`` of ``term_counts``."""
    words = learnt(docs if train is None else train, kind, settings, key=key).select("term", "idf").collect()
    low, high = settings.words if kind == "word" else settings.chars
    terms = [r["term"] for r in words]
    shared = docs.sparkSession.sparkContext.broadcast((grams.Vocabulary(kind, terms, high), np.array([r["idf"] for r in words], float)))
    sublinear = settings.sublinear

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        names = pa.array(known.terms, pa.string())
        for batch in batches:
            rows, texts = grams.flat(batch.column(1))
            for found in grams.placed(kind, texts, rows, low, high, known):
                columns = [batch.column(0).take(pa.array(found[0])), names.take(pa.array(found[1])), pa.array(grams.weighed(*found, idf, sublinear))]
                yield pa.RecordBatch.from_arrays(columns, [key, "term", "weight"])

    lying = _lying(docs, kind, key, "text")
    return lying.mapInArrow(of, f"`{key}` {lying.schema[key].dataType.simpleString()}, term string, weight double")


def feature_names(words: DataFrame, chars: DataFrame) -> DataFrame:
    """kind, term, name of two vocabularies: ``word_`` names, then ``char_`` names."""
    named = lambda v, kind: v.select(F.lit(kind).alias("kind"), "term", F.concat(F.lit(f"{kind}_"), "term").alias("name"))
    return named(words, "word").unionByName(named(chars, "char"))


def top_terms(weights: DataFrame, k: int = 10, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """The ``k`` heaviest terms of each document, lightest first."""
    score: Column = F.round("weight", digits)
    heaviest = Window.partitionBy(key).orderBy(F.desc("s"), "term")
    best = weights.withColumn("s", score).withColumn("r", F.row_number().over(heaviest)).where(F.col("r") <= k)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("r"), "term")))
    return best.groupBy(key).agg(F.transform(listed, lambda x: x["term"]).alias("terms"))


def chi2(weights: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """term and chi-squared statistic of its weight against the label (key, label), as sums per class."""
    totals = labels.groupBy("label").agg(F.count("*").alias("n"))
    share = totals.select("label", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("p"))
    seen = weights.join(labels, key).groupBy("term", "label").agg(F.sum("weight").alias("o"))
    whole = seen.groupBy("term").agg(F.sum("o").alias("total"))
    every = whole.crossJoin(F.broadcast(share)).join(seen, ["term", "label"], "left")
    e, o = F.col("total") * F.col("p"), F.coalesce("o", F.lit(0.0))
    return every.groupBy("term").agg(F.sum((o - e) * (o - e) / e).alias("chi2"))


def chi2_top(weights: DataFrame, labels: DataFrame, k: int, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """The rows of ``weights`` of the ``k`` terms of largest chi-squared statistic (rounded), ties by term."""
    best = chi2(weights, labels, key).withColumn("s", F.round("chi2", digits)).orderBy(F.desc("s"), "term").limit(k)
    return weights.join(F.broadcast(best.select("term")), "term", "left_semi")
