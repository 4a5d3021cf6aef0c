"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. On each level every child draws ``-ln(u) / weight`` from a
hash of the key and the child's name, and the least draw wins, so a child is chosen in proportion
to its weight and a child's draw never depends on its sisters. A new shard opens a region of its
own: only that region's draw is new, so rows move into the new shard and nowhere else.

Defined results: a null text has size 1 and checksum 0; rows with a null doc_id hash as the word
``null`` and share a shard; repeated rows get slots of their own; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, plain, unit_hash

SEED = "tree-1"


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def layout(n: int, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """``n`` shards of weight 1 in regions of ``racks`` racks of ``per_rack`` shards."""
    return [Shard(f"g{i // (racks * per_rack)}", f"k{i // per_rack % racks}", i) for i in range(n)]


def grow(tree: list[Shard], weight: float = 1.0, region: str | None = None, rack: str | None = None) -> list[Shard]:
    """One more shard: in a region of its own, so that rows move into it only, or at a place of the tree.

    At a place, the weights of its region and rack grow: rows move into that region, and within it to that rack, and rows of
    other regions don't move among themselves.
    """
    number = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(region or f"new{number}", rack or "k0", number, weight)]


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; ties go to the earlier child."""
    if len(children) == 1:
        return children[0][2]
    draws = [
        # 1 - u is in (0, 1]: its logarithm is finite.
        F.struct((-F.log(1.0 - unit_hash(SEED, F.lit(path), key)) / F.lit(weight)).alias("d"), F.lit(i).alias("i"))
        for i, (path, weight, _) in enumerate(children)
    ]
    won = F.least(*draws)["i"]
    out = F.when(won == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        out = out.when(won == i, value)
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard number of a key under ``tree``."""
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    top = []
    for region, racks in regions.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{s.number}", s.weight, F.lit(s.number)) for s in shards]
            inner.append((f"{region}/{rack}", sum(s.weight for s in shards), _choose(key, leaves)))
        top.append((region, sum(w for _, w, _ in inner), _choose(key, inner)))
    return _choose(key, top)


def assign(docs: DataFrame, tree: list[Shard], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the column ``name``; rows do not move."""
    return docs.withColumn(name, shard_of(F.col(key), tree).cast("int"))


def digest(docs: DataFrame, n: int = 16) -> DataFrame:
    tree, text = layout(n), F.encode(plain(F.col("text")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(plain(F.col("text"))).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(assign(rows, tree), grow(tree), name="grown_shard")
    return gapless(rows, ["shard"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
