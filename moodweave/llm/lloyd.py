"""Centroid clustering on deduplicated integer vectors.

Components become integers; identical vectors become one row with their number. Lloyd's rounds run on the distinct
vectors: a task finds the nearest centroid of each and adds up whole-number sums, weighted with the numbers; one row per
centroid, component and task is shuffled. At last the assignments are joined back to the ids. Vectors that stand for a
thousandth of all rows or more are at most a thousand, so these are joined by broadcast and no join key is hot.

Everything is whole numbers, so results are the same for every partitioning. Sums are kept in two halves and put
together without a bound; sums of squared distances beyond a long are given as the largest long.

Defined results: vectors that are null, of another length than ``width``, or hold a null or non-finite component are
left out; components beyond ``bound(width)`` count as that bound, so that a squared distance fits a long; repeated rows
and repeated ids are clustered row by row; rows without an id are clustered but start a centroid only after all others;
with fewer vectors than centroids there are fewer centroids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage

CENTROIDS, ROUNDS, SCALE, WIDTH, SEED = 16, 3, 64, 64, "1"
#: A vector of at least this share of all rows is joined by broadcast: no more than 1 / HOT vectors are.
HOT = 0.001
MOST = 2**63 - 1
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def bound(width: int) -> int:
    """The largest component: squared distances of such vectors stay below 2^63."""
    return 1 << ((63 - (width - 1).bit_length()) // 2 - 1)


def quantised(vectors: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """vec_id and q, the components as integers ``floor(scale * x)``, of the vectors that take part."""
    most = float(bound(width))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(most)), F.lit(-most))).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") == width)).where(F.forall("e", finite))
    return rows.select("vec_id", F.transform("e", whole).alias("q"))


def started(kept: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors of smallest hash, as rows: all that comes to the driver."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(draw.asc_nulls_last(), "vec_id", "q").limit(k).collect()
    return np.array([r["q"] for r in first], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, ties to the smaller number; exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # Doubles hold whole numbers up to 2^53, and their products are many times as fast.
    kind = np.float64 if x.shape[1] * 4 * most * most < 2**53 else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    if kind is np.float64:
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x.astype(np.int64), batch.column("n").to_numpy(zero_copy_only=False)


def _weighted_sums(x: np.ndarray, n: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Whole-number sums of ``n`` times each row, per centroid, as Python integers."""
    small = int(np.abs(x).max(initial=0)) * int(n.sum()) < 2**62
    x, n = (x, n) if small else (x.astype(object), n.astype(object))
    return np.array([(n[at == j, None] * x[at == j]).sum(axis=0) for j in range(k)]).astype(object)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact floor of each one's weighted mean; empty ones stay."""
    k, width = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), dtype=object), np.zeros(k, dtype=object)
        for batch in batches:
            x, n = _rows(batch, width)
            at, _ = nearest(x, centroids)
            sums += _weighted_sums(x, n, at, k)
            counts += np.array([int(n[at == j].sum()) for j in range(k)], dtype=object)
        for j in np.flatnonzero(counts > 0).tolist():
            high, low = [int(t) >> 32 for t in sums[j]], [int(t) & 0xFFFFFFFF for t in sums[j]]
            yield pa.RecordBatch.from_pydict({"c": pa.array([j], pa.int32()), "n": pa.array([int(counts[j])], pa.int64()), "high": pa.array([high], pa.list_(pa.int64())), "low": pa.array([low], pa.list_(pa.int64()))})

    parts = distinct.select("q", "n").mapInArrow(partial, "c int, n long, high array<long>, low array<long>")
    each = parts.select("c", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    sums = each.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    out = centroids.copy()
    for r in sums.collect():  # a number per centroid and component
        out[r["c"], r["i"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``distinct`` (q, n) with the number (cluster) and squared distance of the nearest centroid."""
    width = centroids.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = nearest(_rows(batch, width)[0], centroids)
            columns = [batch.column("q"), batch.column("n"), pa.array(at, pa.int32()), pa.array(d, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(of, "q array<int>, n long, cluster int, distance long")


def fit(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """The distinct vectors (q, n), staged, and the centroids after the rounds."""
    distinct = stage(kept.groupBy("q").agg(F.count("*").alias("n")))
    centroids = started(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)
    return distinct, centroids


def _back(kept: DataFrame, found: DataFrame) -> DataFrame:
    """vec_id, cluster and distance of every row: the assignments of distinct vectors joined to all rows."""
    total = found.agg(F.sum("n")).first()[0]
    often = F.col("n") >= F.lit(HOT * total)
    answers = ["q", "cluster", "distance"]
    hot = found.where(often).select(*answers)
    names = ["vec_id", "cluster", "distance"]
    # Arrays are compared only where their hashes are equal.
    keyed = lambda df: df.withColumn("h", F.xxhash64("q"))
    rest = keyed(found.where(~often).select(*answers)).hint("merge")
    if hot.isEmpty():
        return keyed(kept).join(rest, ["h", "q"]).select(*names)
    hot = F.broadcast(hot)
    return kept.join(hot, "q").select(*names).unionByName(keyed(kept.join(hot, "q", "left_anti")).join(rest, ["h", "q"]).select(*names))


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: str = SEED) -> DataFrame:
    """A row per vector that takes part: its centroid, squared distance, the sums of these, and the centroid's digest."""
    kept = quantised(vectors, scale, width)
    distinct, centroids = fit(kept, k, rounds, seed)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], SCHEMA)
    found = stage(assigned(distinct, centroids))
    release(distinct)
    weight = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n"))
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(weight.alias("s")).collect()}
    within = [min(per.get(j, 0), MOST) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    inertia = F.lit(min(sum(per.values()), MOST)).cast("long")
    return _back(kept, found).select("vec_id", "cluster", "distance", at(within).cast("long").alias("cluster_inertia"), inertia.alias("inertia"), at(digests).alias("centroid_sha256"))


def digest(vectors: DataFrame) -> DataFrame:
    return cluster(vectors)


def _sql() -> str:
    d = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    first = "sha256('1:' || vec_id) NULLS LAST, vec_id, q"
    parts = [
        """v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY {first}) - 1 AS c, q FROM v ORDER BY {first} LIMIT 16)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, vec_id, v.q, min({d} * 16 + c.c) AS m FROM v, c{i} c GROUP BY 1, 2, 3)")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT m % 16 AS c, i, sum(q[i])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT m, q, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY 1, 2),
            c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(f.q, c.q) AS q FROM c{i} c LEFT JOIN
              (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY c) f ON f.c = c.c)""")
    return f"""WITH {', '.join(parts)}
    SELECT vec_id, CAST(m % 16 AS INTEGER) AS cluster, CAST(m // 16 AS BIGINT) AS distance, CAST(sum(m // 16) OVER (PARTITION BY m % 16) AS BIGINT) AS cluster_inertia,
      CAST(sum(m // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.c = m % 16"""


SQL = _sql()
