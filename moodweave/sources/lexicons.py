"""Lexicon readers: long and wide files in a canonical (word, emotion, score) form."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.domains import FEATURE_ORDER, ROMANIAN_LABELS, fallback_lexicon, lookup
from .store import exists

LONG = "word string, emotion string, association string"
SCORE_COLUMNS = ("score", "intensity", "flag", "value")


def first_path(spark: SparkSession, candidates: list[str]) -> str | None:
    return next((p for p in candidates if exists(spark, p)), None)


def separator(path: str) -> str:
    return "," if path.endswith(".csv") else "\t"


def associated(rows: DataFrame) -> DataFrame:
    """Long rows whose association is 1 and whose emotion is one of the eight; score 1."""
    emotion = F.lower(F.trim("emotion"))
    kept = rows.where((F.col("association").try_cast("int") == 1) & emotion.isin(*FEATURE_ORDER))
    return kept.select(F.lower(F.trim("word")).alias("word"), emotion.alias("emotion"), F.lit(1.0).alias("score")).distinct()


def read_english(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first lexicon file that exists and parses (headless, tab-separated); else the built-in words."""
    path = first_path(spark, candidates)
    if path is None:
        return fallback_lexicon(spark)
    try:
        rows = spark.read.schema(LONG).option("mode", "FAILFAST").csv(path, sep="\t")
        # All of it is parsed here, as a bad line may stand anywhere; a lexicon is small.
        rows.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError):
        return fallback_lexicon(spark)
    return associated(rows)


def wide_rows(rows: DataFrame) -> DataFrame:
    """A wide table (word and emotion columns, any case) as long rows of the set flags."""
    named = rows.toDF(*[c.strip().lower() for c in rows.columns])
    present = [e for e in FEATURE_ORDER if e in named.columns]
    if "word" not in named.columns:
        raise ValueError(f"a lexicon needs a column word; found {named.columns}")
    word = T.romanian_letters(F.lower(F.trim(F.col("word").cast("string"))))
    long = named.select(word.alias("word"), *[F.col(e).cast("string").alias(e) for e in present]).where("word <> ''")
    value = F.trim("value")
    is_set = value.isin("1", "1.0", "True", "true") | F.coalesce(value.try_cast("double") > 0, F.lit(False))
    flat = long.unpivot(["word"], present, "emotion", "value").where(is_set)
    return flat.select("word", "emotion", F.lit(1.0).alias("score")).distinct()


def long_rows(rows: DataFrame, keep_zero: bool = False) -> DataFrame:
    """A long table (word, emotion and maybe a score) with the largest score of each word and emotion.

    Without ``keep_zero``, scores that aren't positive are dropped.
    """
    named = rows.toDF(*[c.strip().lower() for c in rows.columns])
    if not {"word", "emotion"} <= set(named.columns):
        raise ValueError(f"a lexicon needs the columns word and emotion; found {named.columns}")
    score = next((F.col(c).cast("double") for c in SCORE_COLUMNS if c in named.columns), F.lit(1.0))
    raw = F.lower(F.trim("emotion"))
    emotion = lookup(ROMANIAN_LABELS, raw, raw)
    rows = named.select(T.romanian_letters(F.lower(F.trim("word"))).alias("word"), emotion.alias("emotion"), score.alias("score"))
    best = rows.where(F.col("emotion").isin(*FEATURE_ORDER)).groupBy("word", "emotion").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return best if keep_zero else best.where("score > 0")


def read_romanian(spark: SparkSession, candidates: list[str], keep_zero: bool = False) -> DataFrame:
    """The first lexicon file that exists, long or wide by its header; ``FileNotFoundError`` if there is none."""
    path = first_path(spark, candidates)
    if path is None:
        raise FileNotFoundError(f"no lexicon among {candidates}")
    rows = spark.read.option("header", True).csv(path, sep=separator(path))
    wide = {c.strip().lower() for c in rows.columns} & set(FEATURE_ORDER)
    return wide_rows(rows) if wide else long_rows(rows, keep_zero)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw construction input as long rows (word, emotion, association), from either known layout."""
    header = spark.read.text(path).limit(1).collect()
    if header and "Romanian Word" in header[0][0]:
        rows = spark.read.option("header", True).csv(path, sep="\t")
        flags = [c for c in (*FEATURE_ORDER, "positive", "negative") if c in rows.columns]
        wide = rows.select(F.col("Romanian Word").alias("word"), *[F.col(c).cast("int").alias(c) for c in flags]).where("trim(word) <> ''")
        return wide.unpivot(["word"], flags, "emotion", "association")
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where((F.trim("value") != "") & (F.size(parts) >= 3))
    long = lines.select(parts[0].alias("word"), parts[1].alias("emotion"), F.trim(parts[2]).try_cast("int").alias("association"))
    return long.where("association IS NOT NULL")  # a header row has no number


def is_romanian(text: str) -> bool:
    """Whether the first 1000 characters hold a Romanian letter."""
    return any(c in "ăâîșțĂÂÎȘȚ" for c in text[:1000])


def romanian_sample(column) -> object:
    """The same predicate as a Column."""
    return F.substring(T.plain(column), 1, 1000).rlike("[ăâîșțĂÂÎȘȚ]")


def acquire(spark: SparkSession, candidates: list[str], path: str, sources: dict | None = None) -> tuple[str, list[str]]:
    """Put a raw Romanian lexicon at ``path``: how it came there, and why candidates were passed over.

    ``present``: it stood there. ``copied``: the first candidate that can be read as UTF-8 and is Romanian by its first 1000 characters. ``source``: the rows
    (word, emotion, association) of the first of ``sources`` (callables by name; rows with a language) that has Romanian ones. Else ``placeholder``: a
    header alone, with which construction goes on over no words. The file is written beside and renamed, in one part, as its first line is its header.
    """
    from .checks import AffectError, check_utf8
    from .store import publish

    if exists(spark, path):
        return "present", []
    passed = []
    for found in candidates:
        if not exists(spark, found):
            continue
        try:
            check_utf8(spark, found)
            # A thousand characters stand within the first thousand lines' first thousand characters.
            head = spark.read.text(found).select(F.substring("value", 1, 1000)).limit(1000).collect()
            if not is_romanian("\n".join(r[0] for r in head)):
                passed.append(f"{found}: not Romanian")
                continue
            publish(spark.read.text(found).coalesce(1), path, "text")
            return "copied", passed
        except (PySparkException, Py4JJavaError, AffectError) as error:
            passed.append(f"{found}: {(str(error) or type(error).__name__).splitlines()[0]}")
    header = spark.createDataFrame([("word\temotion\tassociation",)], "value string")
    language = F.lower(F.coalesce("language", F.lit("")))
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(d)) for c, d in (("word", ""), ("emotion", ""), ("association", "0"))])
    for name, open_ in (sources or {}).items():
        try:
            rows = open_().where(language.contains("romanian") | (language == "ro")).select(line.alias("value"))
            if rows.isEmpty():
                passed.append(f"{name}: no Romanian rows")
                continue
            publish(header.unionByName(rows).coalesce(1), path, "text")
            return "source", passed
        except (PySparkException, Py4JJavaError, OSError, ValueError) as error:
            passed.append(f"{name}: {(str(error) or type(error).__name__).splitlines()[0]}")
    publish(header.coalesce(1), path, "text")
    return "placeholder", passed
