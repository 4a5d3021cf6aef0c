"""URL filters by a cascade of Bloom filters.

Rules list pairs of a host and the start of a path; one fits its host and all subdomains. The keys a URL could be listed
under are its host's endings at dots with its path's starts, of the shapes that some rule has. All distinct keys of the corpus are the
universe. The first filter encodes the listed keys; the second those other keys of the universe that the first lets through;
the third the listed keys that the second lets through, and so on until none is let through wrongly. A key of the
universe is listed if the first filter that turns it away is one of the second kind: membership is exact, and no URL is
joined with the rules. A second, small cascade tells the blocked ones of the listed keys.

Filters are built in tasks and put together as words of bits, so what comes to the driver and goes to the tasks is bounded by the
listed keys (about ``1.44 log2(universe / listed)`` bits each); more than ``MOST_KEYS`` of them are taken in parts by hash, one
after the other.

Defined results: a null url, or one without ``://``, has an empty host and path; the longest rule that fits wins (host
and path together, then the longer host), and of rules alike in both the blocking one; a URL that no rule fits
gets the default verdict; repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stage

#: The rules of the registered query: host, start of the path, verdict.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
DEFAULT = "allow"
#: Listed keys of one cascade, and levels after which it is given up (two keys share all 128 bits of their hashes).
MOST_KEYS, MOST_LEVELS = 4_000_000, 60
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.translate(host, _CAPITALS, _CAPITALS.lower()), F.coalesce(path, F.lit(""))


def hashed(host: Column, path: Column) -> Column:
    """128 bits of a key, as a struct of two longs. Hosts hold no slash, so the joint string tells all keys apart."""
    key = F.concat_ws("\n", host, path)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """The (labels of the host, characters of the path) that occur among the rules."""
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    found = rules.select(labels.alias("labels"), F.length("path").alias("chars")).distinct().collect()
    return sorted((r["labels"], r["chars"]) for r in found)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of those shapes that a URL could be listed under, the longest first."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    made = []
    for n, chars in shapes:
        ending, start = F.substring_index(host, ".", -n), F.substring(path, 1, chars)
        key = F.struct(
            (-F.length(ending) - F.length(start)).alias("size"), (-F.length(ending)).alias("of_host"),
            F.concat(ending, start).alias("rule"), hashed(ending, start).alias("hash"),
        )
        made.append(F.when((labels >= n) & (F.length(path) >= chars), key))
    return F.sort_array(F.filter(F.array(*made), lambda k: k.isNotNull()))


class Level:
    """One Bloom filter: bits in words of 64, the number of hash functions, and its place in the cascade."""

    def __init__(self, number: int, n: int, rate: float) -> None:
        self.number, self.size = number, max(64, 64 * math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.words = np.zeros(self.size // 64, dtype=np.uint64)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bits of each key, a column for each hash function; other bits at each level."""
        with np.errstate(over="ignore"):
            salt = np.uint64(self.number) * np.uint64(0x9E3779B97F4A7C15)
            a, b = _mixed(a.astype(np.uint64) + salt), _mixed(b.astype(np.uint64) ^ salt) | np.uint64(1)
            return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.size)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def filled(self, keys: DataFrame) -> Level:
        """The filter with ``keys`` (a, b) put in: tasks give words of bits, and equal words are combined before they are shuffled."""

        def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                at = self.places(f["a"].to_numpy(), f["b"].to_numpy()).ravel()
                word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                order = np.argsort(word, kind="stable")
                starts = np.flatnonzero(np.diff(word[order], prepend=-1))
                if len(starts):
                    yield pd.DataFrame({"word": word[order][starts], "bits": np.bitwise_or.reduceat(bit[order], starts).astype(np.int64)})

        made = keys.select("a", "b").mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        self.words[made["word"].to_numpy()] = made["bits"].to_numpy().astype(np.uint64)
        return self


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all others."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Cascade:
    """Exact membership of the keys of a universe."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key (of the universe) is listed."""
        listed, open_ = np.full(len(a), len(self.levels) % 2 == 1), np.arange(len(a))
        for i, level in enumerate(self.levels):
            if not len(open_):
                break
            kept = level.holds(a[open_], b[open_])
            listed[open_[~kept]] = i % 2 == 1
            open_ = open_[kept]
        return listed

    @classmethod
    def fit(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed`` and ``universe``: distinct keys (a, b); keys that are listed may also be in the universe."""
        inside, levels, n = stage(listed.select("a", "b")), [], 0
        outside, kept = universe.select("a", "b"), [inside]
        sizes = {"in": inside.count(), "all": universe.count()}
        if not sizes["in"]:
            return cls([])
        rate = min(0.5, sizes["in"] / (2**0.5 * max(sizes["all"], 1)))
        n = sizes["in"]
        while n:
            if len(levels) == MOST_LEVELS:
                raise ValueError("two keys have one hash")
            level = Level(len(levels) + 1, n, rate if not levels else 0.5).filled(inside)
            levels.append(level)
            outside = _let_through(outside, level)
            if len(levels) == 1:  # those that are listed do no harm
                outside = outside.join(inside, ["a", "b"], "left_anti")
            outside = stage(outside)
            kept.append(outside)
            inside, outside, n = outside, inside, outside.count()
        release(*kept)
        return cls(levels)


def _let_through(keys: DataFrame, level: Level) -> DataFrame:
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[level.holds(f["a"].to_numpy(), f["b"].to_numpy())]

    return keys.mapInPandas(of, "a long, b long")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, most_keys: int = MOST_KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url). ``rules``: host, path, verdict (allow or block)."""
    host, path = parts_of(F.col("url"))
    rules = stage(rules.select("host", "path", "verdict", hashed(F.col("host"), F.col("path")).alias("hash")))
    found = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidates(F.col("host"), F.col("path"), shapes_of(rules) or [(1, 1)]))
    universe = stage(found.select(F.explode("keys.hash").alias("k")).select("k.a", "k.b").distinct())
    listed = stage(rules.groupBy("hash.a", "hash.b").agg(F.max("verdict").alias("verdict")))  # block comes after allow
    parts = max(1, -(-listed.count() // most_keys))
    # The place of the first key that is listed, times two, and one more if it is blocked.
    found = found.withColumn("at", F.lit(None).cast("int"))
    for part in range(parts):
        own = F.pmod(F.col("a"), F.lit(parts)) == part
        mine = listed.where(own)
        members = Cascade.fit(mine, universe.where(own))
        blocked = Cascade.fit(mine.where("verdict = 'block'"), mine)
        if part:
            found = stage(found)
        found = found.withColumn("at", F.least("at", _first(members, blocked, part, parts)(F.col("keys.hash.a"), F.col("keys.hash.b"))))
    release(universe, listed, rules)
    verdict = F.when(F.col("at").isNull(), F.lit(default)).when(F.col("at") % 2 == 1, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.get(F.col("keys.rule"), F.floor(F.col("at") / 2).cast("int")).alias("rule"), verdict.alias("verdict"))


def _first(members: Cascade, blocked: Cascade, part: int, parts: int):
    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy(dtype=np.int64) if len(a) else np.zeros(0, dtype=np.int64)
        if not sizes.sum():
            return pd.Series([None] * len(a), dtype="Int32")
        a, b = np.concatenate(a.to_numpy()).astype(np.int64), np.concatenate(b.to_numpy()).astype(np.int64)
        owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        held = np.flatnonzero(members.holds(a, b) & (a % parts == part))
        rows, first = np.unique(owner[held], return_index=True)
        held = held[first]
        out = np.full(len(sizes), -1, dtype=np.int64)
        out[rows] = (held - starts[rows]) * 2 + blocked.holds(a[held], b[held])
        return pd.Series(out, dtype="Int32").mask(out < 0)

    return of


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), rule_table(pages.sparkSession))


SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS id, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT id, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT id, page_id, translate(raw, '{_CAPITALS}', '{_CAPITALS.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r(rh, rp, rv) AS (VALUES {', '.join(map(repr, RULES))}
), f AS (
  SELECT id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM p JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp) GROUP BY id
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN f USING (id)
"""
