"""Queries over lexicons, emotion features and lexicon construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.domains import DYADS, FALLBACK_WORDS, FEATURE_ORDER, FLAGS, LEXICON_ORDER, fallback_lexicon, frame
from ..operators import emotions, lexbuild
from ..sources import lexicons
from .base import COUNTS, CUES, HIT, LEXICON, SCORES, TOK, count_sql, lexicon, query, score_sql, table, values

# Synthetic lexicon rows: event types and part words as words, hashed to emotions.
_EMOTIONS = "[" + ", ".join(f"'{f}'" for f in FLAGS) + "]"
_RAW_SQL = f"""raw AS (
  SELECT lower(trim(p_type)) AS word, {_EMOTIONS}[p_partkey % 10 + 1] AS emotion, CAST(p_size % 2 AS INTEGER) AS association FROM part
)"""
_FLAG_MAX = ", ".join(f"CAST(max(CASE WHEN emotion = '{f}' AND association = 1 THEN 1 ELSE 0 END) AS INTEGER) AS {f}" for f in FLAGS)
_MERGED_SQL = f"""{_RAW_SQL}, merged AS (
  SELECT * FROM (SELECT word, {_FLAG_MAX} FROM raw WHERE word <> '' GROUP BY word) WHERE greatest({', '.join(FLAGS)}) = 1
)"""


def raw(spark, sf):
    names = F.array(*map(F.lit, FLAGS))
    emotion = F.get(names, (F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf, "part").select(F.col("p_type").alias("word"), emotion.alias("emotion"), (F.col("p_size") % 2).alias("association"))


@query(
    "lexicon_scan_filter",
    f"""WITH {_RAW_SQL} SELECT DISTINCT word, emotion, 1.0::DOUBLE AS score FROM raw
    WHERE association = 1 AND emotion NOT IN ('positive', 'negative')""",
)
def lexicon_scan_filter(spark, sf):
    return lexicons.associated(raw(spark, sf).withColumn("association", F.col("association").cast("string")))


@query(
    "fallback_lexicon",
    f"""WITH {TOK}, held AS (SELECT DISTINCT doc_id, unnest(toks) AS word FROM tok),
    t(word, emotion, score) AS ({values([(w, e, 1.0) for e, ws in FALLBACK_WORDS.items() for w in ws])})
    SELECT word, emotion, score::DOUBLE AS score, count(doc_id) AS n_docs FROM t LEFT JOIN held USING (word) GROUP BY 1, 2, 3""",
)
def built_in(spark, sf):
    """The built-in words, and how many documents hold each."""
    words = fallback_lexicon(spark)
    held = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.prepared(F.col("text")))).alias("word"))
    # Only the few words of the lexicon are counted, and before anything is shuffled.
    counts = held.join(F.broadcast(words.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("n_docs"))
    return words.join(counts, "word", "left").fillna(0, ["n_docs"]).select("word", "emotion", "score", "n_docs")


@query(
    "lexicon_unpivot",
    f"WITH {_MERGED_SQL} SELECT word, emotion, 1.0::DOUBLE AS score FROM (UNPIVOT merged ON {', '.join(LEXICON_ORDER)} INTO NAME emotion VALUE v) WHERE v > 0",
)
def lexicon_unpivot(spark, sf):
    return lexbuild.unpivoted(lexbuild.merged(lexbuild.one_hot(raw(spark, sf))))


@query(
    "lexicon_wide_scan",
    f"WITH {_MERGED_SQL} SELECT word, emotion, 1.0::DOUBLE AS score FROM (UNPIVOT merged ON {', '.join(FEATURE_ORDER)} INTO NAME emotion VALUE v) WHERE v > 0",
)
def lexicon_wide_scan(spark, sf):
    return lexicons.wide_rows(lexbuild.merged(lexbuild.one_hot(raw(spark, sf))).withColumnRenamed("word", " Word "))


@query(
    "lexicon_max_merge",
    """SELECT word, emotion, greatest(max(score), 0.0) AS score FROM (
      SELECT lower(trim(p_type)) AS word, CASE p_partkey % 4 WHEN 0 THEN 'anger' WHEN 1 THEN 'sadness' WHEN 2 THEN 'joy' ELSE 'fear' END AS emotion,
             (p_size / 10.0)::DOUBLE - 1 AS score FROM part WHERE p_partkey % 5 <> 4)
    GROUP BY word, emotion HAVING max(score) > 0""",
)
def lexicon_max_merge(spark, sf):
    names = F.array(*map(F.lit, ("furie", "tristețe", "bucurie", "fear")))
    kind = F.when(F.col("p_partkey") % 5 == 4, F.lit("other")).otherwise(F.get(names, (F.col("p_partkey") % 4).cast("int")))
    rows = table(spark, sf, "part").select(F.col("p_type").alias("Word"), kind.alias("Emotion"), (F.col("p_size") / 10.0 - 1).alias("Score"))
    return lexicons.long_rows(rows)


def matched(spark, sf):
    ready = emotions.prepare(table(spark, sf, "documents"), CUES)
    return emotions.hits(ready, lexicon(spark), "doc_id")


@query("lexicon_matches", f"WITH {HIT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, emotion, score, is_neg AS is_negated FROM hit")
def lexicon_matches(spark, sf):
    return matched(spark, sf).select("doc_id", "pos", "token", "emotion", "score", "is_negated")


@query("emotion_scores", f"WITH {HIT} SELECT doc_id, {SCORES} FROM hit GROUP BY doc_id")
def emotion_scores(spark, sf):
    return emotions.emotion_scores(matched(spark, sf), "doc_id")


@query("emotion_counts", f"WITH {HIT} SELECT doc_id, {COUNTS} FROM hit GROUP BY doc_id")
def emotion_counts(spark, sf):
    return emotions.emotion_counts(matched(spark, sf), "doc_id")


@query(
    "inversions",
    f"WITH {HIT} SELECT emotion, inverse, CAST(count(*) AS BIGINT) AS n FROM hit WHERE is_neg GROUP BY emotion, inverse",
)
def inversions(spark, sf):
    from ..functions.domains import inverse_of

    rows = matched(spark, sf).where("is_negated").withColumn("inverse", inverse_of(F.col("emotion")))
    return rows.groupBy("emotion", "inverse").agg(F.count("*").alias("n"))


_W = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')"
_STYLE_SQL = r"""(length(t) - length(replace(t, '!', '')))::DOUBLE AS exclamation_count,
 (length(t) - length(replace(t, '?', '')))::DOUBLE AS question_count,
 len(regexp_extract_all(t, '!!+'))::DOUBLE AS repeated_exclamation, len(regexp_extract_all(t, '\?\?+'))::DOUBLE AS repeated_question,
 round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1))::DOUBLE / len(w) END, 9) AS uppercase_ratio"""
_NEGATION_SQL = """CASE WHEN coalesce(k, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_negation, coalesce(k, 0)::DOUBLE AS negation_window_size,
 round(coalesce(k, 0)::DOUBLE / greatest(coalesce(n, 0), 1), 9) AS negation_ratio"""


def _features_sql(compatible: bool) -> str:
    counts = ", ".join(f"CAST({count_sql(e)} AS DOUBLE) AS count_{e}" for e in FEATURE_ORDER)
    sums = ", ".join(f"CAST({score_sql(e)} AS DOUBLE) AS intensity_{e}" for e in FEATURE_ORDER)
    zero = ", ".join(f"coalesce({p}_{e}, 0.0)::DOUBLE AS {p}_{e}" for p in ("count", "intensity") for e in FEATURE_ORDER)
    return f"""WITH {HIT}, f AS (SELECT doc_id, {counts}, {sums} FROM hit GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE is_neg) AS k FROM neg GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS w FROM documents)
    SELECT d.doc_id, {zero}, {_STYLE_SQL}{'' if compatible else ', ' + _NEGATION_SQL}
    FROM d LEFT JOIN f USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _rounded(df):
    ratios = {"uppercase_ratio", "negation_ratio"}
    return df.select(*[F.round(c, 9).alias(c) if c in ratios else F.col(c) for c in df.columns])


@query("lexicon_features", _features_sql(False))
def lexicon_features(spark, sf):
    return _rounded(emotions.lexicon_features(table(spark, sf, "documents"), lexicon(spark), CUES))


@query("lexicon_features_21", _features_sql(True))
def lexicon_features_21(spark, sf):
    return _rounded(emotions.lexicon_features(table(spark, sf, "documents"), lexicon(spark), CUES, compatible=True))


@query("vocabulary_size", "SELECT CAST(count(DISTINCT word) AS BIGINT) AS n_words FROM (" + values(LEXICON) + ") t(word, emotion, score)")
def vocabulary_size(spark, sf):
    return emotions.vocabulary_size(lexicon(spark))


# ---- construction ----
@query(
    "onehot_pivot",
    f"""WITH {_RAW_SQL} SELECT word, {', '.join(f"CASE WHEN emotion = '{f}' AND association = 1 THEN 1 ELSE 0 END AS {f}" for f in FLAGS)} FROM raw""",
)
def onehot_pivot(spark, sf):
    return lexbuild.one_hot(raw(spark, sf))


@query("or_aggregate", f"WITH {_MERGED_SQL} SELECT * FROM merged")
def or_aggregate(spark, sf):
    return lexbuild.merged(lexbuild.one_hot(raw(spark, sf)))


_DYAD_SQL = ", ".join(f"CASE WHEN {a} = 1 AND {b} = 1 THEN 1 ELSE 0 END AS {d}" for d, (a, b) in DYADS.items())


@query("derived_dyads", f"WITH {_MERGED_SQL} SELECT word, {_DYAD_SQL} FROM merged")
def derived_dyads(spark, sf):
    return lexbuild.derived(or_aggregate(spark, sf)).select("word", *DYADS)


# Synsets: a word's material (its last word); synonyms and affect hang on these.
_SYN_SQL = f"""{_MERGED_SQL},
base AS (SELECT *, split_part(word, ' ', 3) AS synset FROM merged),
syn(synset, lemma) AS (VALUES ('tin', ' Zinn'), ('steel', 'stahl '), ('steel', 'acier')),
aff(synset, emotion) AS (VALUES ('brass', 'Joy'), ('brass', 'love'), ('tin', 'anger'), ('copper', 'fear'))"""


def _base(spark, sf):
    words = or_aggregate(spark, sf)
    pos = words.select("word", F.split_part("word", F.lit(" "), F.lit(3)).alias("synset"), F.lit("").alias("sumo"))
    return lexbuild.described(words, pos)


def _synonyms(spark):
    return frame(spark, [("tin", " Zinn"), ("steel", "stahl "), ("steel", "acier")], "synset string, lemma string")


def _affect(spark):
    return frame(spark, [("brass", "Joy"), ("brass", "love"), ("tin", "anger"), ("copper", "fear")], "synset string, emotion string")


@query(
    "synonym_expand",
    f"""WITH {_SYN_SQL} SELECT word, synset, 'emolex' AS provenance, joy FROM base
    UNION ALL SELECT lower(trim(lemma)), synset, 'rownet_synonym', joy FROM base JOIN syn USING (synset) WHERE synset <> ''""",
)
def synonym_expand(spark, sf):
    return lexbuild.expanded(_base(spark, sf), _synonyms(spark)).select("word", "synset", "provenance", "joy")


@query(
    "affect_merge",
    f"""WITH {_SYN_SQL}, a AS (SELECT synset, max((emotion = 'Joy')::INT) AS j, max((emotion = 'anger')::INT) AS g, max((emotion = 'fear')::INT) AS f FROM aff GROUP BY synset)
    SELECT word, CAST(greatest(joy, coalesce(j, 0)) AS INTEGER) AS joy, CAST(greatest(anger, coalesce(g, 0)) AS INTEGER) AS anger,
      CAST(greatest(fear, coalesce(f, 0)) AS INTEGER) AS fear, 'emolex' || CASE WHEN j IS NULL THEN '' ELSE ',wn_affect' END AS provenance
    FROM base LEFT JOIN a USING (synset)""",
)
def affect_merge(spark, sf):
    return lexbuild.with_affect(_base(spark, sf), _affect(spark)).select("word", "joy", "anger", "fear", "provenance")


@query(
    "dedup_keep_first",
    """SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
)
def dedup_keep_first(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")
    ordered = rows.withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    return lexbuild.keep_first(ordered, F.concat_ws("|", "l_partkey", "l_returnflag"), "o").drop("o")


_KEY_SQL = " || '|' || ".join(f"'{f}:' || {f}" for f in FLAGS)


@query(
    "lexicon_row_keys",
    f"WITH {_SYN_SQL} SELECT lower(trim(word)) || '|' || CASE WHEN regexp_matches(word, '(are|ere|ire|ă|ează)$') THEN 'v' WHEN regexp_matches(word, '(ie|ție)$') THEN 'n' WHEN regexp_matches(word, '(ic|esc|os)$') THEN 'a' ELSE '' END || '|' || {_KEY_SQL} || '|' || synset AS row_key FROM base",
)
def lexicon_row_keys(spark, sf):
    return _base(spark, sf).select(lexbuild.row_key().alias("row_key"))


@query(
    "flag_distribution",
    f"WITH {_MERGED_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, CAST(coalesce(sum({f}), 0) AS BIGINT) AS n_rows FROM merged" for f in FLAGS),
)
def flag_distribution(spark, sf):
    return lexbuild.flag_distribution(or_aggregate(spark, sf))


@query(
    "duplicate_stats",
    """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(DISTINCT (event_type, user_id)) AS BIGINT) AS unique_rows,
      CAST(count(*) - count(DISTINCT (event_type, user_id)) AS BIGINT) AS duplicates FROM events""",
)
def duplicate_stats(spark, sf):
    return lexbuild.duplicate_stats(table(spark, sf, "events").select("event_type", "user_id"))


@query(
    "schema_diff",
    """WITH e(c) AS (VALUES ('word'), ('joy'), ('text'), ('lang')), a(c) AS (SELECT column_name FROM (DESCRIBE documents))
    SELECT (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT c FROM e EXCEPT SELECT c FROM a)) AS missing,
      (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT c FROM a EXCEPT SELECT c FROM e)) AS extra, false AS valid, (SELECT count(*) FROM documents) AS n_rows""",
)
def schema_diff(spark, sf):
    """What a lexicon's fields and those of the documents don't share, and the number of rows that this concerns."""
    docs = table(spark, sf, "documents")
    out = lexbuild.schema_diff(spark, ["word", "joy", "text", "lang"], docs.columns).crossJoin(docs.agg(F.count("*").alias("n_rows")))  # one row each
    return out.select(F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "valid", "n_rows")


@query(
    "expansion_ratio",
    f"""WITH {_SYN_SQL}, n AS (SELECT count(*) AS a, count(*) + (SELECT count(*) FROM base JOIN syn USING (synset) WHERE synset <> '') AS b FROM base)
    SELECT CAST(a AS BIGINT) AS n_in, CAST(b AS BIGINT) AS n_out, round(CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE b::DOUBLE / a END, 9) AS ratio FROM n""",
)
def expansion_ratio(spark, sf):
    base = _base(spark, sf)
    counts = base.agg(F.count("*").alias("n_in")).crossJoin(lexbuild.expanded(base, _synonyms(spark)).agg(F.count("*").alias("n_out")))
    return counts.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("n_out").cast("double"), F.col("n_in").cast("double")), F.lit(0.0)), 9))


@query(
    "lexicon_build",
    f"""WITH {_MERGED_SQL}, b AS (SELECT word, anger, anticipation, disgust, fear, CAST(greatest(joy, CASE WHEN split_part(word, ' ', 3) = 'brass' THEN 1 ELSE 0 END) AS INTEGER) AS joy, sadness, surprise, trust FROM merged)
    SELECT word, joy, {_DYAD_SQL} FROM b""",
)
def lexicon_build(spark, sf):
    words = lexbuild.merged(lexbuild.one_hot(raw(spark, sf)))
    synsets = words.select("word", F.split_part("word", F.lit(" "), F.lit(3)).alias("synset"), F.lit("").alias("sumo"))
    affect = frame(spark, [("brass", "joy")], "synset string, emotion string")
    return lexbuild.build(raw(spark, sf), synsets, None, affect).select("word", "joy", *DYADS)
