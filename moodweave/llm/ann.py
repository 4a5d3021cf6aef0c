"""Approximate nearest neighbours by a permutation index.

Pivots are vectors drawn by hash, more of them the more vectors there are (``pivots_for``). A vector is represented by its
``PREFIX`` nearest pivots in
order; each index block posts its vectors in inverted files, one per pivot, with the pivot's place. A
query adds up, over the files of its own pivots and no others, what shared pivots take off the footrule
distance, takes the nearest share of each block and ranks these again by exact cosine. Equal
vectors are one class and are searched once.

What a query touches in the files is prefix^2 / pivots entries a vector, which falls with the square root of their number; what it
ranks again is a share of them, as vectors without structure (the nearest hardly nearer than others) leave no shorter list
at this recall. A task holds one block of the index and one of the queries.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part, nor does a null vec_id; a query with fewer candidates than asked
for gets all of them; rows that repeat a vec_id count once, with the least of their vectors (compared by component);
components of any finite size are scored, as vectors are scaled by a power of two first; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

#: Pivots of a vector's prefix; the least and the most pivots, and their number over the square root of the vectors'.
PREFIX = 64
PIVOTS, PER_ROOT = (128, 4096), 4
#: Vectors of an index block, queries of a query block.
BLOCK, QUERIES = 8192, 65_536
#: Share of a block that is ranked again by the exact measure, and the least number.
SHARE, LEAST = 0.06, 256
EVERY, NEAREST = 50, 5


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    rows = rows.where(e.isNotNull() & F.col("vec_id").isNotNull()).where(
        F.forall(e, finite) & F.exists(e, lambda x: x != 0)
    )
    # 0.0 and -0.0 are one number, but two array elements.
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows if sizes is None else rows.where(F.size("embedding") == sizes["d"])


class Block:
    """The inverted files of one block of vectors."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int) -> None:
        self.x, self.norm, self.pivots, self.prefix = x, np.sqrt((x * x).sum(axis=1)), pivots, prefix
        near = orders(x, pivots, prefix)
        flat, place = near.ravel(), np.tile(np.arange(prefix), len(x))
        by_pivot = np.argsort(flat, kind="stable")
        self.vector, self.place = by_pivot // prefix, place[by_pivot].astype(np.int32)
        self.ends = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def search(self, q: np.ndarray, order: np.ndarray, n: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` best of the ``n`` nearest by footrule: positions and exact cosines."""
        shared = np.zeros(len(self.x), dtype=np.int32)
        for at, p in enumerate(order):
            lo, hi = self.ends[p], self.ends[p + 1]
            # A shared pivot at places a and b shortens the footrule by 2 (prefix - max(a, b)).
            shared[self.vector[lo:hi]] += self.prefix - np.maximum(self.place[lo:hi], at)
        chosen = np.argpartition(-shared, n - 1)[:n] if n < len(shared) else np.arange(len(shared))
        cosine = (self.x[chosen] * q).sum(axis=1) / (self.norm[chosen] * np.sqrt((q * q).sum()))
        best = np.lexsort((chosen, -cosine))[:keep]
        return chosen[best], cosine[best]


def pivots_for(n: int) -> int:
    """The number of pivots for ``n`` vectors."""
    return max(PIVOTS[0], min(PIVOTS[1], int(PER_ROOT * n**0.5)))


def scaled(vectors) -> np.ndarray:
    """Vectors as rows, each times a power of two that brings its largest component to between 1/2 and 1; cosines stay."""
    x = np.stack(vectors)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots by cosine, nearest first, ties to the smaller number."""
    near = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def search(
    vectors: DataFrame,
    is_query: Column | None = None,
    k: int = NEAREST,
    pivots: int | None = None,
    prefix: int = PREFIX,
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each query row, its own row excluded."""
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    rows = stage(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("q", is_query))
    # Any k others and the query itself lie among the k + 1 least ids of a class; the rank limit cuts
    # each class down before the shuffle.
    least = Window.partitionBy("embedding").orderBy("vec_id")
    members = (
        rows.select("vec_id", "embedding")
        .withColumn("r", F.row_number().over(least))
        .where(F.col("r") <= k + 1)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    flags = rows.groupBy("embedding").agg(F.max("q").alias("q"))
    classes = stage(members.join(flags, "embedding").withColumn("cid", F.col("ids")[0]))
    n, n_queries = classes.agg(F.count("*"), F.count_if("q")).first()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    drawn = classes.orderBy(F.xxhash64(F.lit(7), "cid"), "cid").limit(pivots_for(n) if pivots is None else pivots).select("embedding").collect()
    table = scaled([np.array(r["embedding"]) for r in drawn])
    table = table / np.sqrt((table * table).sum(axis=1, keepdims=True))
    prefix = min(prefix, len(table))
    blocks, queries = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))

    def numbers(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def dealt(m: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "cid"), F.lit(m)).cast("int")

    index = classes.select("cid", "embedding", dealt(blocks, 1).alias("block")).withColumn("part", numbers(queries))
    asked = classes.where("q").select("cid", "embedding", dealt(queries, 2).alias("part")).withColumn("block", numbers(blocks))

    def within(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", "cid", "score"]
        if not len(own) or not len(ask):
            return pd.DataFrame({"qid": [], "cid": [], "score": []}).astype({"qid": "int64", "cid": "int64", "score": "float64"})
        own = own.sort_values("cid")
        block, cid = Block(scaled(own["embedding"].to_numpy()), table, prefix), own["cid"].to_numpy()
        x = scaled(ask["embedding"].to_numpy())
        m, out = min(len(own), max(LEAST, int(share * len(own)))), []
        for q, order, qid in zip(x, orders(x, table, prefix), ask["cid"].to_numpy(), strict=True):
            at, score = block.search(q, order, m, k + 1)
            out.append(pd.DataFrame({"qid": qid, "cid": cid[at], "score": score}))
        return pd.concat(out)[names]

    found = index.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(within, "qid long, cid long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    near = stage(found.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id")))
    each = rows.where("q").select(F.col("vec_id").alias("query_id"), "embedding")
    each = each.join(classes.where("q").select(F.col("cid").alias("qid"), "embedding"), "embedding").select("query_id", "qid")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.join(near, "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(nearest))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors)
