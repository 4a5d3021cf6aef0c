"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage

#: Edges (16 bytes each) that one task may join up by itself; more are joined by rounds.
FEW = 200_000


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One round over edges (a, b): larger neighbours, or the others, are hung on the least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    # The least neighbour comes from a grouped minimum, which is combined before the shuffle.
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["k"])
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("k").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def _at_once(batches):
    """(a, b) for every node a but the least node b of its component, over all batches."""
    least: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while least.setdefault(x, x) != x:
            path.append(x)
            x = least[x]
        for p in path:
            least[p] = x
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
    pairs = np.array([(x, root(x)) for x in least if root(x) != x], dtype=np.int64).reshape(-1, 2)
    yield pd.DataFrame(pairs, columns=["a", "b"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); the component is its least node.

    Null ends are no nodes. At most ``few`` edges, a bounded table, are joined up in one task. Beyond it, every
    round is written to the shared folder; nothing but one checksum a round comes to the driver. No edges, no rows.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= few:
        now = stage(now.coalesce(1).mapInPandas(_at_once, "a long, b long"))
        rounds = 0
    seen = None
    for k in range(rounds):
        before, now = now, stage(_stars(_stars(now, True), False))
        release(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        seen = mark
        if k + 1 == rounds:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
