"""Lexicon construction: raw rows to a flagged, deduplicated, derived lexicon, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.domains import DYADS, FLAGS, LEXICON_ORDER

FIELDS = ("word", *FLAGS, "synset", "pos", "sumo", "provenance")
FINAL_FIELDS = (*FIELDS, *DYADS)


def one_hot(raw: DataFrame) -> DataFrame:
    """Long rows (word, emotion, association) as one row of flags each."""
    emotion = F.lower(F.trim("emotion"))
    flags = [F.when((emotion == f) & (F.col("association") == 1), 1).otherwise(0).alias(f) for f in FLAGS]
    return raw.select(F.lower(F.trim("word")).alias("word"), *flags)


def merged(flagged: DataFrame) -> DataFrame:
    """One row per word: a flag is set if any row of the word sets it; words without flags go."""
    some = F.greatest(*[F.col(f) for f in FLAGS]) == 1
    return flagged.where((F.col("word") != "") & some).groupBy("word").agg(*[F.max(f).cast("int").alias(f) for f in FLAGS])


def described(words: DataFrame, synsets: DataFrame | None = None) -> DataFrame:
    """Add synset, pos, sumo and provenance; ``synsets`` (word, synset, sumo) is optional."""
    out = words.withColumn("pos", T.pos_tag(F.col("word")))
    if synsets is None:
        out = out.withColumn("synset", F.lit("")).withColumn("sumo", F.lit(""))
    else:
        out = out.join(synsets.select("word", "synset", "sumo"), "word", "left").fillna("", ["synset", "sumo"])
    return out.withColumn("provenance", F.lit("emolex")).select(*FIELDS)


def expanded(lexicon: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """The lexicon and, for each lemma of a row's synset (synset, lemma), the row under that word."""
    if synonyms is None:
        return lexicon
    more = lexicon.where(F.trim("synset") != "").join(synonyms, "synset")
    more = more.withColumn("word", F.lower(F.trim("lemma"))).withColumn("provenance", F.lit("rownet_synonym"))
    return lexicon.unionByName(more.select(*lexicon.columns))


def with_affect(lexicon: DataFrame, affect: DataFrame | None = None) -> DataFrame:
    """Flags of the synset's emotions (synset, emotion) are set as well, and provenance says so."""
    if affect is None:
        return lexicon
    six = ("anger", "disgust", "fear", "joy", "sadness", "surprise")
    sets = affect.groupBy(F.trim("synset").alias("_synset")).agg(
        *[F.max((F.lower("emotion") == e).cast("int")).alias(f"_{e}") for e in six]
    )
    out = lexicon.join(sets, F.trim("synset") == F.col("_synset"), "left")
    for e in six:
        out = out.withColumn(e, F.greatest(F.col(e), F.coalesce(f"_{e}", F.lit(0))))
    marked = F.when(F.col("_synset").isNotNull(), F.concat("provenance", F.lit(",wn_affect"))).otherwise(F.col("provenance"))
    return out.withColumn("provenance", marked).select(*lexicon.columns)


def derived(lexicon: DataFrame) -> DataFrame:
    """Add the compound emotions: 1 where both parents are."""
    both = lambda a, b: F.when((F.col(a) == 1) & (F.col(b) == 1), 1).otherwise(0)
    return lexicon.select("*", *[both(a, b).alias(name) for name, (a, b) in DYADS.items()])


def row_key() -> Column:
    """word, pos, flags and synset as one string, to be shown."""
    tags = F.concat_ws("|", *[F.concat(F.lit(f"{f}:"), F.col(f).cast("string")) for f in FLAGS])
    return F.concat_ws("|", F.lower(F.trim("word")), F.trim("pos"), tags, F.trim("synset"))


def row_identity() -> Column:
    """The same as a struct, in which neither nulls nor separators within values run together."""
    return F.struct(F.lower(F.trim("word")), F.trim("pos"), *[F.col(f) for f in FLAGS], F.trim("synset"))


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by ``order``, ties by the other columns in turn; the rank limit cuts each task's groups before the shuffle."""
    by = Window.partitionBy("_key").orderBy(order, *[F.col(c) for c in rows.columns if c != order])
    return rows.withColumn("_key", key).withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_key", "_r")


def build(raw: DataFrame, synsets=None, synonyms=None, affect=None) -> DataFrame:
    """The whole construction from long raw rows."""
    base = expanded(described(merged(one_hot(raw)), synsets), synonyms)
    first = keep_first(base.withColumn("_o", F.when(F.col("provenance") == "emolex", 0).otherwise(1)), row_identity(), "_o").drop("_o")
    return derived(with_affect(first, affect)).select(*FINAL_FIELDS)


def construction(raw: str, synsets: str | None = None, synonyms: str | None = None, affect: str | None = None) -> list:
    """The construction as restartable steps over paths: a raw lexicon, and Parquet tables of synsets, synonyms and affect, if there are any.

    ``sources.steps.run`` makes them; the step ``derived`` holds what ``build`` gives for the same tables.
    """
    from pyspark.sql import SparkSession

    from ..sources.lexicons import read_raw
    from ..sources.steps import Step

    at = lambda path: None if path is None else SparkSession.active().read.parquet(path)
    given = lambda *paths: tuple(p for p in paths if p is not None)
    order = F.when(F.col("provenance") == "emolex", 0).otherwise(1)
    return [
        Step("normalized", lambda: merged(one_hot(read_raw(SparkSession.active(), raw))), sources=(raw,)),
        Step("mapped", lambda normalized: described(normalized, at(synsets)), ("normalized",), given(synsets)),
        Step("expanded", lambda mapped: keep_first(expanded(mapped, at(synonyms)).withColumn("_o", order), row_identity(), "_o").drop("_o"), ("mapped",), given(synonyms)),
        Step("affected", lambda expanded: with_affect(expanded, at(affect)), ("expanded",), given(affect)),
        Step("derived", lambda affected: derived(affected).select(*FINAL_FIELDS), ("affected",)),
    ]


def duplicate_stats(rows: DataFrame) -> DataFrame:
    """total_rows, unique_rows and duplicates over whole rows."""
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"), F.count("*").alias("unique_rows"))
    return out.withColumn("duplicates", F.col("total_rows") - F.col("unique_rows"))


def flag_distribution(lexicon: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """flag and the number of rows that set it."""
    sums = lexicon.agg(*[F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags])
    return sums.unpivot([], list(flags), "flag", "n_rows")


def schema_diff(spark, expected: list[str], actual: list[str]) -> DataFrame:
    """missing and extra field names, sorted, and whether the schema is valid (nothing missing)."""
    row = spark.range(1).select(F.array(*map(F.lit, expected)).alias("e"), F.array(*map(F.lit, actual)).alias("a"))
    sides = row.select(F.array_sort(F.array_except("e", "a")).alias("missing"), F.array_sort(F.array_except("a", "e")).alias("extra"))
    return sides.withColumn("valid", F.size("missing") == 0)


def validation(lexicon: DataFrame, expected: tuple[str, ...] = FINAL_FIELDS) -> dict:
    """All statistics of a lexicon: schema, duplicates and flags (a few rows come to the driver)."""
    diff = schema_diff(lexicon.sparkSession, list(expected), lexicon.columns).first()
    dup = duplicate_stats(lexicon).first()
    some = F.greatest(*[F.col(f) for f in FLAGS]) == 1
    return {
        "schema": {"missing_fields": diff["missing"], "extra_fields": diff["extra"], "schema_valid": diff["valid"]},
        "duplicates": dup.asDict(),
        "emotion_distribution": {r["flag"]: r["n_rows"] for r in flag_distribution(lexicon).collect()},
        "rows_with_emotions": lexicon.where(some).count(),
    }


def unpivoted(wide: DataFrame, columns: tuple[str, ...] = LEXICON_ORDER) -> DataFrame:
    """Wide flags as long rows (word, emotion, score 1) of the flags that are set."""
    return wide.unpivot(["word"], list(columns), "emotion", "value").where("value > 0").select("word", "emotion", F.lit(1.0).alias("score"))
