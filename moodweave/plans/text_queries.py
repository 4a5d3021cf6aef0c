"""Queries over text operators: cleaning, tokens, style, negation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.domains import CUES as ALL_CUES
from ..operators import emotions, ranks
from ..sources.lexicons import romanian_sample
from .base import CUES, HIT, NEG, SHORT, TOK, WORD, lexicon, query, table



@query("clean_urls", r"SELECT page_id, regexp_replace(coalesce(url, ''), 'http\S+|www\.\S+', '', 'g') AS cleaned FROM pages")
def clean_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.drop_urls(T.plain(F.col("url"))).alias("cleaned"))


@query("clean_mentions", rf"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '@{WORD}+', '', 'g')) AS digest FROM documents")
def clean_mentions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.drop_mentions(T.plain(F.col("text")))).alias("digest"))


@query("unwrap_hashtags", rf"SELECT page_id, md5(regexp_replace(coalesce(html, ''), '#({WORD}+)', '\1', 'g')) AS digest FROM pages")
def unwrap_hashtags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.unwrap_hashtags(T.plain(F.col("html")))).alias("digest"))


@query("elongation", f"WITH c AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS a FROM documents) SELECT doc_id, md5({SHORT}) AS digest FROM c")
def elongation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.shorten_runs(T.plain(F.col("text")))).alias("digest"))


@query(
    "tokenize",
    rf"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}+') AS t FROM documents)""",
)
def tokenize(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", T.tokens(F.lower(T.plain(F.col("text")))).alias("t"))
    return words.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("preprocess_text", f"WITH {TOK} SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM tok")
def preprocess_text(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", T.prepared(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


_UPPER = rf"""list_filter(w, lambda t: t = upper(t) AND t <> lower(t) AND length(t) > 1)"""


@query(
    "stylistic_features",
    rf"""SELECT doc_id, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS exclamation_count,
      CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS question_count,
      CAST(len(regexp_extract_all(text, '!!+')) AS BIGINT) AS repeated_exclamation,
      CAST(len(regexp_extract_all(text, '\?\?+')) AS BIGINT) AS repeated_question,
      round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len({_UPPER})::DOUBLE / len(w) END, 9) AS uppercase_ratio
    FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w FROM documents)""",
)
def stylistic_features(spark, sf):
    s = T.style(F.col("text"))
    counts = [v.cast("long").alias(k) for k, v in s.items() if k != "uppercase_ratio"]
    return table(spark, sf, "documents").select("doc_id", *counts, F.round(s["uppercase_ratio"], 9).alias("uppercase_ratio"))


@query("diacritics", "SELECT doc_id, md5(translate(replace(coalesce(text, ''), 'ç', 'ş'), 'şŞţŢ', 'șȘțȚ')) AS digest FROM documents")
def diacritics(spark, sf):
    # The tables have no Romanian text; French cedillas stand in for the letters.
    text = F.replace(T.plain(F.col("text")), F.lit("ç"), F.lit("ş"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.romanian_letters(text)).alias("digest"))


@query(
    "pos_heuristic",
    f"""WITH {TOK}, w AS (SELECT DISTINCT unnest(toks) AS word FROM tok)
    SELECT word, CASE WHEN ends_with(word, 'are') OR ends_with(word, 'ere') OR ends_with(word, 'ire') OR ends_with(word, 'ă') OR ends_with(word, 'ează') THEN 'v'
      WHEN ends_with(word, 'ie') OR ends_with(word, 'ție') THEN 'n'
      WHEN ends_with(word, 'ic') OR ends_with(word, 'esc') OR ends_with(word, 'os') THEN 'a' ELSE '' END AS pos FROM w""",
)
def pos_heuristic(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(T.prepared(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.pos_tag(F.col("word")).alias("pos"))


@query("romanian_sample", "SELECT doc_id, regexp_matches(substr(coalesce(text, ''), 1, 1000), '[ăâîșțĂÂÎȘȚ]') AS romanian FROM documents")
def romanian_letters_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id", romanian_sample(F.col("text")).alias("romanian"))


@query(
    "negation_positions",
    f"WITH {NEG} SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM neg WHERE is_neg GROUP BY doc_id",
)
def negation_positions(spark, sf):
    ready = emotions.negated_documents(table(spark, sf, "documents"), CUES, "doc_id")
    return ready.select("doc_id", F.array_join(F.transform("negated", lambda i: i.cast("string")), ",").alias("positions"))


_BY_LANG = " OR ".join(
    f"(lang {'=' if lang == 'en' else '<>'} 'en' AND token IN (" + ", ".join("'" + c.replace("'", "''") + "'" for c in ALL_CUES[lang]) + "))"
    for lang in ("en", "ro")
)


@query(
    "negation_cues_by_language",
    f"""WITH {TOK}, long AS (SELECT doc_id, lang, unnest(toks) AS token FROM tok)
    SELECT lang, CAST(count(*) FILTER (WHERE {_BY_LANG}) AS BIGINT) AS n_cues, CAST(count(*) AS BIGINT) AS n_tokens FROM long GROUP BY lang""",
)
def negation_cues_by_language(spark, sf):
    docs = table(spark, sf, "documents").select("lang", T.cue_array(F.col("lang")).alias("cues"), T.prepared(F.col("text")).alias("t"))
    cues = docs.select("lang", F.size(F.filter("t", lambda t: F.array_contains("cues", t))).alias("c"), F.size("t").alias("n"))
    return cues.groupBy("lang").agg(F.sum("c").alias("n_cues"), F.sum("n").alias("n_tokens"))


@query(
    "negation_features",
    f"""WITH {NEG}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE is_neg) AS k FROM neg GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN coalesce(k, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_negation, coalesce(k, 0)::DOUBLE AS negation_window_size,
      round(coalesce(k, 0)::DOUBLE / greatest(coalesce(n, 0), 1), 9) AS negation_ratio, coalesce(k, 0)::DOUBLE AS negated_tokens
    FROM documents d LEFT JOIN s USING (doc_id)""",
)
def negation_features(spark, sf):
    ready = emotions.prepare(table(spark, sf, "documents"), CUES)
    found = T.negation_features(F.size("negated"), F.size("tokens"))
    return ready.select("doc_id", *[(F.round(v, 9) if k == "negation_ratio" else v).alias(k) for k, v in found.items()])


@query(
    "negated_emotion_words",
    f"WITH {HIT} SELECT doc_id, array_to_string(list_sort(list(DISTINCT token)), ' ') AS words FROM hit WHERE is_neg GROUP BY doc_id",
)
def negated_emotion_words(spark, sf):
    ready = emotions.prepare(table(spark, sf, "documents"), CUES)
    matched = emotions.hits(ready, lexicon(spark), "doc_id")
    return emotions.negated_words(matched, "doc_id").select("doc_id", F.array_join("words", " ").alias("words"))


@query(
    "guessed_language",
    f"""WITH {TOK} SELECT doc_id, CASE WHEN list_has_any(toks, ['nu', 'niciodată', 'fără', 'nici', 'niciun', 'niciuna']) THEN 'ro' ELSE 'en' END AS guess FROM tok""",
)
def guessed_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.guessed_language(T.prepared(F.col("text"))).alias("guess"))


@query("batch_numbering", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 + 1 AS BIGINT) AS batch FROM documents")
def batch_numbering(spark, sf):
    return ranks.batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 32).select("doc_id", "batch")


