"""Quality rules as a short-circuit cascade, in native expressions only.

Both the time that a rule takes and the share of rows that it rejects are measured on a bounded hash sample;
the cascade tries the rules by rejections per second, and ``CASE WHEN`` stops at the first that
rejects. The order changes the work, never the verdict; ``failed_rule`` names the rule that came first in it.

Defined results: a null text counts as the empty text and fails (no words); tables may be empty or
have more columns, which are kept unless they are named like a result; repeated rows are judged alike.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, release, stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of the sample that orders the cascade (drawn by hash; twice as many at most), how often a rule is
#: evaluated on each in one timed run at first and at most, and how many runs the best is taken of.
SAMPLE_ROWS, REPEATS, MOST_REPEATS, RUNS = 1000, 10, 160, 2
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, chars: str) -> Column:
    """How often the characters of a regular-expression class stand in the text."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def split_words(text: Column) -> Column:
    """The words of a text: all white space becomes spaces, as splitting at one character is cheap."""
    return F.filter(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), lambda w: w != "")


def split_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def repeats_before(words: Column) -> Column:
    """Words that equal the word before them."""
    twice = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: a == b)
    return let(words, lambda w: F.when(F.size(w) < 2, F.lit(0)).otherwise(F.size(F.filter(twice(w), lambda x: x))))


def window_hashes(words: Column) -> Column:
    """A hash of each ``WINDOW``-word window, doubled up from hashes of words, pairs and fours."""

    def doubled(hashes: Column, width: int) -> Column:
        left = lambda h: F.greatest(F.size(h) - width, F.lit(0))
        mixed = lambda a, b: F.xxhash64(a, b)
        return let(hashes, lambda h: F.zip_with(F.slice(h, 1, left(h)), F.slice(h, width + 1, left(h)), mixed))

    return doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more, the first one included.

    Hashes of the windows tell whether any can repeat. Only then they are sorted, so that equal
    windows are neighbours, these are compared word by word, and the positions they cover summed.
    """

    def covered(at: Column) -> Column:
        following = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.element_at(at, -1) + WINDOW))
        return F.aggregate(F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)

    def positions(w: Column, hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        window = lambda e: F.slice(w, e["i"] + 1, WINDOW)
        same = lambda a, b: F.when(a["h"] == b["h"], window(a) == window(b)).otherwise(False)
        hit = lambda s: lambda e, j: same(e, F.get(s, j - 1)) | same(e, F.get(s, j + 1))
        twice = let(keyed, lambda s: F.transform(F.filter(s, hit(s)), lambda e: e["i"]))
        return let(F.array_sort(twice), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(covered(at)))

    def count(w: Column, hashes: Column) -> Column:
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), positions(w, h)).otherwise(F.lit(0)))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(count(w, window_hashes(w))))


def facts(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text (never null) and the ``BASE`` columns of each row."""
    text = plain(F.col("text"))
    of = lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        F.length(F.array_join(w, "")).cast("long").alias("chars"),
        repeated_words(w).cast("long").alias("repeat"),
    )
    twice = let(split_lines(text), lambda s: F.size(s) - F.size(F.array_distinct(s)))
    found = docs.select(
        F.struct(*docs.columns).alias("row"), text.alias("text"), let(split_words(text), of).alias("w"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"), twice.cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("w.n") < 20) | (F.lit(100) * F.col("w.repeat") > F.lit(30) * F.col("w.n"))
    return found.select(
        "row", "text", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", "n_dup_lines",
        F.col("w.repeat").alias("n_repeat_words"), failed.alias("base_failed"),
    )


def _unpacked(docs: DataFrame, judged: DataFrame, *added: str) -> DataFrame:
    """The columns of ``docs``, but for those named like a result, and the results."""
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def with_base(docs: DataFrame) -> DataFrame:
    """Add the base statistics and ``base_failed`` to each row of ``docs``."""
    return _unpacked(docs, facts(docs), *BASE)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the ``BASE`` columns and the text."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Rules beyond the base ones. Ratios are compared in whole numbers."""
    words, text = F.col("n_words"), F.col("text")
    return [
        Rule("symbols", F.lit(10) * F.col("n_symbols") > words),
        Rule("word_length", (F.col("word_chars") > 25 * words) | (F.col("word_chars") < 2 * words)),
        Rule("dup_lines", F.lit(2) * F.col("n_dup_lines") > F.size(F.split(text, "\n"))),
        Rule("stutter", F.lit(4) * repeats_before(split_words(text)) > words),
        Rule("shouting", F.lit(4) * count_of(text, "!") > words),
    ]


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows, and twice as many at most, drawn by a hash of their place in the table."""
    every = max(1, docs.count() // max(rows, 1))
    drawn = docs.select("text", F.monotonically_increasing_id().alias("at")).where(F.pmod(F.xxhash64(F.lit(7), "at"), F.lit(every)) == 0)
    return drawn.select("text").limit(2 * rows)


def measured(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """By rule: the share of a sample that it rejects, and its seconds a row there.

    Each rule is timed by itself, against runs that read the same rows and evaluate nothing, and is evaluated more often until the
    difference is twice the spread of those; one number a run comes to the driver.
    """
    sample = stage(facts(sampled(docs, sample_rows)).drop("row"))
    rows, empty = max(1, sample.count()), {}

    def run(condition: Column, times: int) -> tuple[list[float], int]:
        many, spans, found = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times)))), [], 0
        for _ in range(RUNS):
            began = time.perf_counter()
            found = many.agg(F.count_if(condition & (F.length("text") >= 0))).first()[0]
            spans.append(time.perf_counter() - began)
        return spans, found

    out = {}
    for r in rules:
        times = REPEATS
        while True:
            spans, found = run(r.rejects, times)
            if times not in empty:
                empty[times] = run(F.col("again") > times, times)[0]
            spent, noise = min(spans) - min(empty[times]), max(empty[times]) - min(empty[times])
            if spent > 2 * noise or times >= MOST_REPEATS:
                break
            times *= 4
        out[r.name] = (found / (rows * times), max(spent, noise, 1e-3) / (rows * times))
    release(sample)
    return out


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of ``docs``; ties, and rules that reject nothing there, the cheaper first."""
    known = measured(docs, rules, sample_rows)
    share, cost = ({k: v[i] for k, v in known.items()} for i in (0, 1))
    return sorted(rules, key=lambda r: (-share[r.name] / cost[r.name], cost[r.name], r.name))


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the base columns, ``kept`` and ``failed_rule`` (null if kept) to each row."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for r in ordered(docs, default_rules() if rules is None else rules, sample_rows):
        verdict = verdict.when(r.rejects, F.lit(r.name))
    judged = facts(docs).withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())
    return _unpacked(docs, judged, *BASE, "failed_rule", "kept")


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), grams AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), dup AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid
), s AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(string_split(text, chr(10))) AS n_lines,
         length(text) - length(replace(text, '!', '')) AS n_bangs,
         len(list_filter(words, lambda x, i: i > 1 AND words[i - 1] = x)) AS n_stutters
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words
            OR 2 * n_dup_lines > n_lines OR 4 * n_bangs > n_words OR 4 * n_stutters > n_words) AS kept
FROM b
"""
