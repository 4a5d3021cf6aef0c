"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are grouped by equal values and read as the leaves of binary tries, which are joined with themselves:
node pairs are descended together, differing bits add up, and a pair is dropped once they exceed the budget
(``trie``). So that tries fit a task, the fingerprint is cut into bands, a few more than the budget; two
fingerprints within it agree on as many bands as there are more, so tries are dealt below each choice of that many shared bands,
and each is walked with the whole budget. The more fingerprints there are, the more bands are shared. A trie
emits a spanning forest of its links, never all pairs, and connected components of all forests give the groups.

``near_duplicates`` links 64-bit fingerprints of four-word shingles at ``BUDGET`` bits. ``similar`` is for a
shingle similarity: fingerprints of 256 bits of five-word shingles are walked from ``OFFSETS`` places, with a budget for the
first bits and one for all; the exact similarity of the shingle sets then decides within components of what is found.

Defined results: null and wordless texts have fingerprint zero, which links like any other; rows
with a null doc_id are fingerprinted and linked, but name no component (null if none of its rows
has an id); repeated rows share a component; an empty table gives no rows; further columns are
ignored. ``keep_one`` keeps all columns and, of rows that share a doc_id, every one whose text is like
no other.
"""

from __future__ import annotations

from array import array
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trie
from .common import checked, id_key, release, row_key, stage
from .components import components

BITS, BUDGET, SHINGLE = trie.BITS, 4, 4
#: Fingerprints of a trie that is walked whole; a larger one is dealt as pairs of parts of this size.
TRIE = 1000
#: For similarity: shingle words and the similarity itself.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Parts of a wide fingerprint, of 64 bits each; the bits at which a walk begins in the ring of all.
PARTS = ("f0", "f1", "f2", "f3")
OFFSETS = tuple(256 * i // 12 for i in range(12))
#: Errors within the first bits of a walk, within its 64 bits, and within these and 64 others.
FIRST, WALK, BOTH = (24, 2), 18, 30
#: Bands that lead at least, however few the fingerprints.
LEAD = 2
#: Shingles of a part of a group; a larger group is dealt as pairs of parts. Beyond so many parts, parts grow to the second size.
CROWD, CROWDS, MOST = 20_000, 64, 2_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def _cuts(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words as one line, and where in it each shingle starts and ends; fewer words are one shingle."""
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    return b" ".join(words), (ends - [len(w) + 1 for w in words])[:n].tolist(), (ends[len(words) - n :] - 1).tolist()


def fingerprint(text: str | None, width: int = SHINGLE) -> bytes:
    """The SimHash of a text's word shingles, most significant byte first."""
    words = _words(text)
    if not words:
        return bytes(8)
    line, starts, stops = _cuts(words, width)
    n = len(starts)
    ones, step = np.zeros(BITS, dtype=np.int64), 1 << 14
    for k in range(0, n, step):  # bounded memory for long texts
        hashes = b"".join([xxhash.xxh64_digest(line[i:j], 42) for i, j in zip(starts[k : k + step], stops[k : k + step], strict=False)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], width: int = WIDE_SHINGLE) -> np.ndarray:
    """A 64-bit hash of each shingle, made from hashes of its words; fewer words are one shingle."""
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 42)
    each = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    n = max(min(1, len(words)), len(words) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(words))):
        out = _mixed(out + each[k : k + n] + np.uint64(k))
    return out


def shingles(text: str | None, width: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes (signed) of a text's word shingles; none if it has no words."""
    return np.unique(shingle_hashes(_words(text), width).view(np.int64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of 256 bits of shingle hashes, as four signed longs; zero for none."""
    n, ones, step = len(hashes), np.zeros(4 * BITS, dtype=np.int64), 1 << 13
    lanes = (np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for k in range(0, n, step):
        part = _mixed(hashes[k : k + step, None] ^ lanes)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets (sorted, distinct) is ``similarity`` or more; empty sets are alike."""
    few, many = sorted((len(a), len(b)))
    if few < similarity * many - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (few + many - both) - 1e-9


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (a signed long) of each row of ``docs``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        known: dict = {}
        for t in texts:
            if t not in known:
                known[t] = fingerprint(t, width)
        return pd.Series(np.frombuffer(b"".join([known[t] for t in texts]), dtype=">i8").astype(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of("text").alias("fp"))


class Tables:
    """How the first ``bits`` bits are cut into ``errors + shared`` bands, and the choices of ``shared`` bands that lead."""

    def __init__(self, bits: int, errors: int, shared: int) -> None:
        n = errors + shared
        edge = [bits * i // n for i in range(n + 1)]
        self.bits, self.bands = bits, [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]
        self.choices = list(combinations(range(n), shared))

    @classmethod
    def of(cls, n: int, bits: int, errors: int, shared: int = 1) -> Tables:
        """The fewest shared bands, from ``shared`` on, at which tries of ``n`` fingerprints are small on the average."""
        while n >> (bits * shared // (errors + shared)) > TRIE // 4 and comb(errors + shared + 1, shared + 1) <= 80:
            shared += 1
        return cls(bits, errors, shared)

    def width(self, k: int) -> int:
        """Leading bits that the fingerprints of a trie of table ``k`` agree on."""
        return sum(self.bands[i][1] for i in self.choices[k])

    def keys(self, walk: Column) -> list[Column]:
        """For each table, the bits of the leading bands, below 2^40, of a signed long."""
        out = []
        for choice in self.choices:
            key = F.lit(0).cast("long")
            for at, n in (self.bands[i] for i in choice):
                key = F.call_function("shiftleft", key, F.lit(n)) + F.shiftrightunsigned(walk, BITS - at - n).bitwiseAND(F.lit((1 << n) - 1))
            out.append(key)
        return out

    def led(self, k: int, f: np.ndarray) -> np.ndarray:
        """The fingerprints with the bands of table ``k`` first, then the others; bits beyond the bands stay."""
        order = [*self.choices[k], *(i for i in range(len(self.bands)) if i not in self.choices[k])]
        out = np.zeros(len(f), dtype=np.uint64)
        for at, n in [*(self.bands[i] for i in order), *([(self.bits, BITS - self.bits)] if self.bits < BITS else [])]:
            value = (f >> np.uint64(BITS - at - n)) & np.uint64((1 << n) - 1)
            out = value if n == BITS else (out << np.uint64(n)) | value
        return out


def _walks(tables: Tables, budget: int, prefix: tuple[int, int] | None, both: int | None):
    """A function over batches sorted by (key, p, q) that emits the forests of their tries."""

    def walked(rows: pd.DataFrame, table: int, shared: int, out: list) -> None:
        f = tables.led(table % len(tables.choices), rows["f"].to_numpy().view(np.uint64))
        at = np.argsort(f, kind="stable")
        node, near = rows["node"].to_numpy()[at], None
        f = f[at]
        if both is not None:
            other = rows["other"].to_numpy().view(np.uint64)[at]
            near = lambda i, j: np.bitwise_count(f[i] ^ f[j]) + np.bitwise_count(other[i] ^ other[j]) <= both
        for i, j in trie.links(f, budget, shared, prefix, near):
            out.append((node[i], node[j]))

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        table, split = rows["key"].to_numpy() >> 40, ((rows["p"] > 0) | (rows["q"] > 0)).to_numpy()
        # Tries that are walked whole lie side by side in one array per table.
        for t in np.unique(table[~split]):
            walked(rows[~split & (table == t)], int(t), tables.width(int(t) % len(tables.choices)), out)
        for (key, _, _), group in rows[split].groupby(["key", "p", "q"], sort=False):
            walked(group, int(key) >> 40, tables.width((int(key) >> 40) % len(tables.choices)), out)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def forests(batches):
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            # The last group may go on in the next batch.
            marks = rows[["key", "p", "q"]].to_numpy()
            differ = (marks != marks[-1]).any(axis=1)
            start = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
            held = rows.iloc[start:]
            if start:
                yield edges(rows.iloc[:start])
        if held is not None:
            yield edges(held)

    return forests


def links(nodes: DataFrame, walks: list[tuple[Column, Column]], tables: Tables, budget: int, prefix=None, both: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links; staged.

    ``walks``: the 64 bits that a trie reads, and 64 other ones, for each place at which a walk begins.
    """
    n = len(tables.choices)
    each = [
        F.struct((F.lit((w * n + k) << 40) + key).alias("key"), walk.alias("f"), other.alias("other"))
        for w, (walk, other) in enumerate(walks)
        for k, key in enumerate(tables.keys(walk))
    ]
    dealt = nodes.select("node", F.explode(F.array(*each)).alias("t")).select("node", "t.*")
    # Only tries that are too large for one task are listed; the counts are combined before they move.
    large = stage(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TRIE))
    parts = F.ceil(F.coalesce("n", F.lit(1)) / TRIE).cast("int")
    dealt = dealt.join(checked(large), "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int"))
    keys = ["key", "p", "q"]
    placed = dealt.withColumn("pair", F.explode(_part_pairs(parts))).select("key", "node", "f", "other", "pair.p", "pair.q")
    found = placed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_walks(tables, budget, prefix, both), "a long, b long")
    out = stage(found)
    release(large)
    return out


def _part_pairs(parts: Column) -> Column:
    """The pairs (p, q), p <= q, of parts that a row of part ``own`` takes part in; with one part, only (0, 0)."""
    return F.transform(
        F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("p"), F.greatest(p, F.col("own")).alias("q"))
    )


def near_duplicates(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of each row of ``docs``."""
    rows = stage(fingerprints(docs, width))
    # Classes are numbered in the order of their least ids (none: last), so the least node of a component names it.
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).orderBy(F.col("least").asc_nulls_last())
    named = stage(named.withColumn("node", F.monotonically_increasing_id()))
    tables = Tables.of(named.count(), BITS, budget)
    edges = links(named, [(F.col("fp"), F.lit(0).cast("long"))], tables, budget)
    found = components(edges)
    release(edges)
    heads = named.join(checked(stage(found.select("component").distinct())), F.col("node") == F.col("component"))
    heads = checked(stage(heads.select("component", F.col("least").alias("component_id"))))
    grouped = stage(found.join(heads, "component").select("node", "component_id", F.lit(True).alias("linked")))
    table = named.join(checked(grouped), "node", "left")
    table = table.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(table, "fp").select("doc_id", "fp", "component_id")


def marks(docs: DataFrame, width: int = WIDE_SHINGLE) -> DataFrame:
    """did and tid of each row, a hash (c, d) of its words in order, and its 256 bits in ``PARTS``."""

    @F.pandas_udf(", ".join(f"{x} long" for x in ("c", "d", *PARTS)))
    def of(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for t in texts:
            if t not in known:
                words = _words(t)
                same = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words), 42), dtype=np.int64)
                known[t] = np.concatenate((same, wide_fingerprint(shingle_hashes(words, width))))
        found = np.stack([known[t] for t in texts]) if len(texts) else np.zeros((0, 6), dtype=np.int64)
        return pd.DataFrame(found, columns=["c", "d", *PARTS])

    return docs.select(*row_key(), of("text").alias("f")).select("did", "tid", "f.*")


def rings() -> list[tuple[Column, Column]]:
    """The 64 bits from each of ``OFFSETS`` on, in the ring of all parts, and the 64 of the part farthest away."""
    out = []
    for at in OFFSETS:
        a, b = divmod(at, BITS)
        here, following = F.col(PARTS[a]), F.col(PARTS[(a + 1) % 4])
        walk = here if b == 0 else F.call_function("shiftleft", here, F.lit(b)).bitwiseOR(F.shiftrightunsigned(following, BITS - b))
        out.append((walk, F.col(PARTS[(a + 2) % 4])))
    return out


def set_links(sets: list[np.ndarray], sides: list[int] | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that are alike; with ``sides``, of those between two sides.

    Sets that are alike share one of their first members (a fifth of each, and one), which are posted; only sets that
    are not in one component yet are compared.
    """
    forest, posts = trie.Forest(len(sets)), {}
    size = np.array([len(s) for s in sets])
    side = None if sides is None else np.array(sides)
    for i, s in enumerate(sets):
        first = s[: len(s) - ceil(similarity * len(s) - 1e-9) + 1].tolist() or [None]  # all empty sets share one post
        lists = [posts.setdefault(x, array("q")) for x in first]
        seen = [np.frombuffer(p, dtype=np.int64) for p in lists if len(p)]
        # The first of each post is tried before the others: they mostly are in its component.
        for pick in ([p[:1] for p in seen], seen) if seen else ():
            others, shared = np.unique(np.concatenate(pick), return_counts=True)
            fits = (forest.label[others] != forest.label[i]) & (np.minimum(size[others], len(s)) >= similarity * np.maximum(size[others], len(s)) - 1e-9)
            if side is not None:
                fits &= side[others] != side[i]
            others = others[fits][np.argsort(-shared[fits], kind="stable")]
            for j in others.tolist():
                if forest.label[j] != forest.label[i] and alike(s, sets[j], similarity):
                    forest.join(np.array([i]), np.array([j]))
        del seen  # posts can't grow while they are looked at
        pick = None
        for p in lists:
            p.append(i)
    return forest.edges


def verified(sets: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all alike pairs within a group. ``sets``: staged group, node, items."""
    sizes = sets.groupBy("group").agg(F.sum(F.size("items") + 1).alias("size")).where(F.col("size") > crowd)
    size = F.coalesce("size", F.lit(1))
    parts = F.greatest(F.least(F.ceil(size / crowd), F.lit(CROWDS)), F.ceil(size / MOST)).cast("int")
    dealt = sets.join(checked(stage(sizes)), "group", "left").withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int"))
    keys = ["group", "p", "q"]
    dealt = dealt.withColumn("pair", F.explode(_part_pairs(parts))).select("group", "node", "items", "own", "pair.p", "pair.q")

    def edges(batches):
        at, nodes, items, sides = None, [], [], []

        def found() -> pd.DataFrame:
            pairs = set_links(items, None if at is None or at[1] == at[2] else sides, similarity)
            return pd.DataFrame([(nodes[i], nodes[j]) for i, j in pairs], columns=["a", "b"], dtype="int64")

        for batch in batches:
            for group, node, item, own, p, q in batch.itertuples(index=False):
                if (group, p, q) != at:
                    yield found()
                    at, nodes, items, sides = (group, p, q), [], [], []
                nodes.append(node)
                items.append(np.asarray(item, dtype=np.int64))
                sides.append(own)
        yield found()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(edges, "a long, b long")


def similar(docs: DataFrame, width: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """did, tid, their number of rows n, and the group of texts over links of this shingle similarity or more; staged."""
    rows = stage(marks(docs, width))
    # Texts of the same words are one node, and one of them stands for all.
    nodes = rows.groupBy("c", "d").agg(F.min("did").alias("did"), F.min_by("tid", "did").alias("tid"), *[F.max(x).alias(x) for x in PARTS])
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = links(nodes, rings(), Tables.of(nodes.count(), *FIRST, LEAD), WALK, FIRST, BOTH)
    loose = components(found)
    wanted = stage(nodes.select("did", "tid", "node").join(loose, "node").withColumnRenamed("component", "group"))

    @F.pandas_udf("array<long>")
    def items(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width) for t in texts], dtype=object)

    # The grouping keeps one of repeated rows.
    sets = docs.select(*row_key(), F.col("text").alias("text")).join(checked(wanted), ["did", "tid"])
    sets = stage(sets.select("group", "node", items("text").alias("items")).groupBy("group", "node").agg(F.any_value("items").alias("items")))
    edges = stage(verified(sets, similarity))
    near = components(edges)
    whole = nodes.join(checked(stage(near)), "node", "left").select("c", "d", F.coalesce("component", "node").alias("group"))
    units = rows.groupBy("did", "tid").agg(F.max("c").alias("c"), F.max("d").alias("d"), F.count("*").alias("n"))
    out = stage(units.join(whole, ["c", "d"]).select("did", "tid", "n", "group"))
    release(rows, nodes, found, wanted, sets, edges)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their group of ``similar`` texts: one with the group's least doc_id.

    Rows are told by doc_id and text, so that rows which share an id go only with texts like their own. As
    no id tells whether a row without one is a document of its own, one such row of a group stays too.
    """
    units = similar(docs)
    least = units.groupBy("group", (F.col("did") == id_key(F.lit(None))).alias("nameless")).agg(
        F.min(F.struct("did", "tid")).alias("least"), F.sum("n").alias("all")
    )
    crowded = least.where("all > 1").select("group", "least")
    named = F.col("least.did") == F.col("did")
    judged = units.join(checked(stage(crowded)), "group").where((F.col("did") == id_key(F.lit(None))) == (F.col("least.did") == id_key(F.lit(None))))
    judged = stage(judged.select("did", "tid", "n", (named & (F.col("least.tid") == F.col("tid"))).alias("stays")))
    # The whole row travels as one column, so that its names clash with none of ours.
    rows = docs.select(*row_key(), F.struct(*docs.columns).alias("row"))
    back = lambda x: x.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    out = rows.join(checked(stage(judged.where("NOT stays").select("did", "tid"))), ["did", "tid"], "left_anti")
    again = stage(judged.where("stays AND n > 1").select("did", "tid"))
    if again.isEmpty():
        return back(out)
    again = checked(again)
    once = out.join(again, ["did", "tid"], "left_semi").dropDuplicates(["did", "tid"])
    return back(out.join(again, ["did", "tid"], "left_anti").unionByName(once))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
