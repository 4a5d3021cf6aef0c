"""The registry of queries, the fixtures they run with, and SQL fragments of their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.domains import FEATURE_ORDER, INVERSE, frame

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A lexicon whose words occur in the driver's tables (FIXTURES.md).
LEXICON = (
    ("trash", "disgust", 1.0), ("worthless", "sadness", 1.0), ("idiot", "anger", 1.0), ("scum", "disgust", 1.0),
    ("moron", "anger", 1.0), ("pathetic", "sadness", 1.0), ("clown", "surprise", 1.0), ("disgusting", "disgust", 1.0),
    ("disgusting", "anger", 0.5), ("with", "trust", 1.0), ("this", "anticipation", 1.0), ("from", "fear", 1.0),
    ("und", "joy", 1.0), ("les", "trust", 0.5), ("que", "joy", 0.5),
)
#: Cues that occur there: the effective English ones and four that only serve as fixtures.
CUES = ("not", "never", "no", "cannot", "by", "of", "de", "der")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return frame(spark, LEXICON, "word string, emotion string, score double")


def values(rows) -> str:
    """Rows as an SQL VALUES list."""
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# ---- fragments: independent SQL formulations of the text operators ----
WORD = r"[\p{L}\p{N}_]"
STRIPPED = (
    rf"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'http\S+|www\.\S+', '', 'g'), '@{WORD}+', '', 'g'), "
    rf"'#({WORD}+)', '\1', 'g')"
)
SHORT = (
    "array_to_string(list_filter(a, lambda ch, i: NOT (i > 2 AND ch <> chr(10) AND a[i - 1] = ch AND a[i - 2] = ch)), '')"
)
CUE_LIST = "(" + ", ".join(f"'{c}'" for c in CUES) + ")"

#: tok(doc_id, toks): prepared tokens of every document.
TOK = rf"""
chars AS (SELECT doc_id, lang, text, string_split({STRIPPED}, '') AS a FROM documents),
tok AS (SELECT doc_id, lang, text, regexp_extract_all(lower({SHORT}), '{WORD}+') AS toks FROM chars)
"""
#: neg(doc_id, pos, token, is_neg): a row per token, pos from 0.
NEG = rf"""{TOK},
long AS (
  SELECT doc_id, u.pos - 1 AS pos, toks[u.pos] AS token
  FROM tok, LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS pos) u
),
neg AS (
  SELECT doc_id, pos, token, coalesce(max(CASE WHEN token IN {CUE_LIST} THEN 1 ELSE 0 END) OVER
         (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 1 AS is_neg
  FROM long
)
"""
#: hit(doc_id, pos, token, is_neg, emotion, score): matches with the fixture lexicon.
HIT = f"""{NEG},
lex(word, emotion, score) AS ({values(LEXICON)}),
inv(emotion, inverse) AS ({values(INVERSE.items())}),
hit AS (SELECT n.*, l.emotion, l.score::DOUBLE AS score, i.inverse FROM neg n JOIN lex l ON n.token = l.word JOIN inv i USING (emotion))
"""


def score_sql(e: str) -> str:
    return (
        f"round(coalesce(sum(CASE WHEN NOT is_neg THEN CASE WHEN emotion = '{e}' THEN score ELSE 0 END "
        f"ELSE CASE WHEN emotion = '{e}' THEN 0.1::DOUBLE * score ELSE 0 END + CASE WHEN inverse = '{e}' THEN 0.5::DOUBLE * score ELSE 0 END END), 0), 6)"
    )


def count_sql(e: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN emotion = '{e}' AND NOT is_neg THEN 1 ELSE 0 END), 0) AS BIGINT)"


SCORES = ", ".join(f"CAST({score_sql(e)} AS DOUBLE) AS {e}" for e in FEATURE_ORDER)
COUNTS = ", ".join(f"{count_sql(e)} AS {e}" for e in FEATURE_ORDER)
