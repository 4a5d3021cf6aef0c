"""Tokens, lexicon matches and the per-document emotion features, one shuffle on the document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.domains import FEATURE_ORDER, INVERTED_WEIGHT, KEPT_WEIGHT, inverse_of
from .sizes import checked, few_values

STYLE = ("exclamation_count", "question_count", "repeated_exclamation", "repeated_question", "uppercase_ratio")
NEGATION = ("has_negation", "negation_window_size", "negation_ratio")
#: The 24 features in their fixed order; the first 21 are the compatible form.
FEATURES = (*[f"count_{e}" for e in FEATURE_ORDER], *[f"intensity_{e}" for e in FEATURE_ORDER], *STYLE, *NEGATION)
COMPATIBLE = FEATURES[:21]
#: Most words of a lexicon that are looked up before tokens become rows.
LOOKED_UP = 20_000


def prepare(docs: DataFrame, cues=None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``tokens``, ``negated`` (positions) and ``flags`` (of each token, whether it is negated).

    ``cues``: a tuple for all languages, or by language. What a query doesn't read is not computed.
    """
    chosen = cues if isinstance(cues, tuple) else T.cue_array(F.col(lang), cues)
    out = docs.withColumn("tokens", T.prepared(F.col(text)))
    return out.withColumn("negated", T.negated_positions(F.col("tokens"), chosen)).withColumn("flags", T.negated_flags(F.col("tokens"), chosen))


def negated_documents(docs: DataFrame, cues, *keep: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` and the negated positions (``negated``) of the documents that have any.

    The list is looked at inside of the row's only array, so that no filter repeats the cleaning of the text below a projection that does it again.
    """
    chosen = cues if isinstance(cues, tuple) else T.cue_array(F.col(lang), cues)
    found = F.filter(F.array(T.negated_positions(T.prepared(F.col(text)), chosen)), lambda p: F.size(p) > 0)
    return docs.select(*keep, F.explode(found).alias("negated"))


def _in(token: str, words, romanian: bool = False) -> str:
    """SQL: whether a token is one of ``words``."""
    listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) or "NULL"
    return (f"translate({token}, 'şŞţŢ', 'șȘțȚ')" if romanian else token) + f" IN ({listed})"


def token_rows(prepared: DataFrame, *keep: str, outer: bool = False, words: list[str] | None = None, romanian: bool = False) -> DataFrame:
    """A row per token: ``keep``, pos, token, is_negated. With ``words``, only of these tokens.

    With ``outer``, a document without such a token has one row without a token.
    """
    explode = F.explode_outer if outer else F.explode
    each = "transform(arrays_zip(tokens, flags), (t, i) -> struct(i AS pos, t.tokens AS token, t.flags AS is_negated))"
    if words is not None:
        each = f"filter(transform(arrays_zip(tokens, flags), (t, i) -> CASE WHEN {_in('t.tokens', words, romanian)} THEN struct(i AS pos, t.tokens AS token, t.flags AS is_negated) END), t -> t IS NOT NULL)"
    rows = prepared.select(*keep, explode(F.expr(each)).alias("t"))
    return rows.select(*keep, "t.pos", "t.token", F.coalesce("t.is_negated", F.lit(False)).alias("is_negated"))


def matches(rows: DataFrame, lexicon: DataFrame, romanian: bool = False, how: str = "inner") -> DataFrame:
    """Token rows joined with the lexicon's (emotion, score) of the token; fans out over emotions."""
    words = checked(lexicon.select(F.col("word").alias("_word"), "emotion", "score"))
    probe = T.romanian_letters(F.col("token")) if romanian else F.col("token")
    return rows.withColumn("_probe", probe).join(words, F.col("_probe") == F.col("_word"), how).drop("_probe", "_word")


def hits(prepared: DataFrame, lexicon: DataFrame, *keep: str, romanian: bool = False, outer: bool = False) -> DataFrame:
    """The lexicon matches of prepared documents. Of a lexicon of bearable size, only tokens that it holds become rows."""
    words = few_values(lexicon.where("word IS NOT NULL").select("word"), LOOKED_UP)
    rows = token_rows(prepared, *keep, outer=outer, words=words, romanian=romanian)
    return matches(rows, lexicon, romanian, "left" if outer else "inner")


def weighed(matched: DataFrame) -> DataFrame:
    """``matched`` with what a word gives to its emotion (``_own``), and to the inverse one (``_turned``, ``_other``) if it is negated."""
    negated = F.col("is_negated")
    own = F.when(negated, F.col("score") * KEPT_WEIGHT).otherwise(F.col("score"))
    return matched.withColumns({"_own": own, "_turned": F.when(negated, inverse_of(F.col("emotion"))), "_other": F.col("score") * INVERTED_WEIGHT})


def score_of(emotion: str) -> Column:
    """The sum of an emotion's scores over ``weighed`` rows: a negated word gives half to its inverse and a tenth to itself."""
    own = F.when(F.col("emotion") == emotion, F.col("_own")).otherwise(0.0)
    other = F.when(F.col("_turned") == emotion, F.col("_other")).otherwise(0.0)
    return F.coalesce(F.sum(own + other), F.lit(0.0))


def count_of(emotion: str) -> Column:
    """Words of an emotion that stand outside negation windows."""
    return F.count_if((F.col("emotion") == emotion) & ~F.col("is_negated"))


def emotion_scores(matched: DataFrame, *by: str) -> DataFrame:
    return weighed(matched).groupBy(*by).agg(*[F.round(score_of(e), 6).alias(e) for e in FEATURE_ORDER])


def emotion_counts(matched: DataFrame, *by: str) -> DataFrame:
    return matched.groupBy(*by).agg(*[count_of(e).alias(e) for e in FEATURE_ORDER])


def _marked(docs: DataFrame, cues, words: list[str], romanian: bool) -> DataFrame:
    """``docs`` as ``prepare`` makes them, but with the ``tokens`` and ``flags`` of cues and of the lexicon's ``words`` alone, and the numbers of all tokens and of negated ones.

    Each token is looked at once; all else is over the few that count.
    """
    both = T.CUES if cues is None else cues
    listed = set(both if isinstance(both, tuple) else (c for x in both.values() for c in x))
    # One list, if a token is looked up in both as it stands.
    counts = _in("t", sorted({*listed, *words})) if not romanian else f"{_in('t', sorted(listed))} OR {_in('t', words, True)}"
    chosen = cues if isinstance(cues, tuple) else T.cue_array(F.col("lang"), cues)
    is_cue = (lambda w: w.isin(*cues)) if isinstance(cues, tuple) else (lambda w: F.array_contains(chosen, w))
    found = F.expr(f"filter(transform(tokens, (t, i) -> CASE WHEN {counts} THEN struct(i AS pos, t AS token) END), m -> m IS NOT NULL)")
    out = docs.withColumn("tokens", T.prepared(F.col("text"))).withColumns({"n_tokens": F.size("tokens"), "_found": found})
    told = F.transform("_found", lambda m: F.struct(m["pos"].alias("pos"), m["token"].alias("token"), is_cue(m["token"]).alias("is_cue")))
    out = out.withColumn("_marks", told)
    flags, negated = T.near_cues(F.col("_marks"), F.col("n_tokens"))
    return out.withColumns({"tokens": F.col("_marks")["token"], "flags": flags, "negated": negated}).drop("_found", "_marks")


def lexicon_features(docs: DataFrame, lexicon: DataFrame, cues=None, romanian: bool = False, compatible: bool = False, key: str = "doc_id") -> DataFrame:
    """``key`` and the features of each document.

    Style and negation columns ride along through the grouping (``first``), which is combined before
    its shuffle, so a document's tokens leave their task as one row.
    """
    side = T.style(F.col("text"))
    words = few_values(lexicon.where("word IS NOT NULL").select("word"), LOOKED_UP)
    if words is None:
        ready = prepare(docs, cues)
        negated, size = F.size(F.filter("flags", lambda x: x)), F.size("tokens")
    else:
        ready = _marked(docs, cues, words, romanian)
        negated, size = F.col("negated"), F.col("n_tokens")
    side |= {k: v for k, v in T.negation_features(negated, size).items() if k in NEGATION}
    ready = ready.select(key, "tokens", "flags", *[v.alias(k) for k, v in side.items()])
    rows = matches(token_rows(ready, key, *side, outer=True, words=words, romanian=romanian), lexicon, romanian, "left")
    counted = [count_of(e).cast("double").alias(f"count_{e}") for e in FEATURE_ORDER]
    summed = [F.round(score_of(e), 6).alias(f"intensity_{e}") for e in FEATURE_ORDER]
    firsts = [F.first(c).cast("double").alias(c) for c in side]
    return weighed(rows).groupBy(key).agg(*counted, *summed, *firsts).select(key, *(COMPATIBLE if compatible else FEATURES))


def negated_words(matched: DataFrame, *by: str) -> DataFrame:
    """The sorted distinct emotion words that stand in a negation window."""
    return matched.where("is_negated").groupBy(*by).agg(F.array_sort(F.collect_set("token")).alias("words"))


def vocabulary_size(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.count_distinct("word").alias("n_words"))


def fitted_width(features: Column, width: int) -> Column:
    """A feature array cut, or filled with zeros on the right, to the width that a model expects."""
    return F.slice(F.concat(features, F.array_repeat(F.lit(0.0), width)), 1, width)
