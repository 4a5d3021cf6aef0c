"""Self-join of binary tries within a Hamming error budget, in numpy.

A trie is the sorted array of its fingerprints: a node is a range of it, whose members agree above its
branching bit. Pairs of nodes are descended together. The bits that both nodes have settled add up to
``apart``, and a pair is dropped once these exceed the budget; a pair whose members are in one component
already is dropped too, as only components are asked for. The walk ends at single fingerprints.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 64
#: Node pairs handled at once.
CHUNK = 1 << 16
_ONE = np.uint64(1)


@dataclass
class Tally:
    """Node pairs that the walk visited, dropped for their bits, and dropped as joined already; links at the leaves."""

    visited: int = 0
    pruned: int = 0
    joined: int = 0
    leaves: int = 0


class Forest:
    """Components of positions: a label for each, at hand as an array, and the edges that made them."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []
        self._members: dict[int, np.ndarray] = {}
        self._count()

    def _count(self) -> None:
        """How often the label changes up to each position: equal counts mean one label throughout."""
        self._changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1]))) if len(self.label) else self.label

    def members(self, label: int) -> np.ndarray:
        return self._members.get(label, np.array([label]))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Unite the positions of each pair, a thousand at a time, as most pairs of a dense group are joined by then."""
        any_joined = False
        while True:
            open_ = self.label[i] != self.label[j]
            i, j = i[open_], j[open_]
            if not len(i):
                break
            any_joined = True
            for x, y in zip(i[:1000].tolist(), j[:1000].tolist(), strict=True):
                a, b = int(self.label[x]), int(self.label[y])
                if a != b:
                    own, other = self.members(a), self.members(b)
                    if len(own) < len(other):
                        a, b, own, other = b, a, other, own
                    self.label[other] = a
                    self._members[a] = np.concatenate((own, other))
                    self._members.pop(b, None)
                    self.edges.append((x, y))
            i, j = i[1000:], j[1000:]
        if any_joined:
            self._count()

    def settled(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether all members of both ranges have one label."""
        c = self._changes
        return (c[hi - 1] == c[lo]) & (c[hi2 - 1] == c[lo2]) & (self.label[lo] == self.label[lo2])


def width(x: np.ndarray) -> np.ndarray:
    """The number of bits up to the highest one that is set."""
    x = x.copy()
    for step in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(step)
    return np.bitwise_count(x).astype(np.int64)


def above(x: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The bits of ``x`` from ``bit`` (0 to 64) on."""
    return np.where(bit >= BITS, np.uint64(0), x >> np.minimum(bit, BITS - 1).astype(np.uint64))


def _expanded(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray):
    """All pairs of positions of pairs of ranges, in bounded pieces."""
    for a, b, c, d in zip(lo.tolist(), hi.tolist(), lo2.tolist(), hi2.tolist(), strict=True):
        step = max(1, CHUNK // (d - c))
        for s in range(a, b, step):
            x, y = np.meshgrid(np.arange(s, min(b, s + step)), np.arange(c, d), indexing="ij")
            yield x.ravel(), y.ravel()


def links(f: np.ndarray, budget: int, shared: int = 0, prefix: tuple[int, int] | None = None, near=None, tally: Tally | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of positions that differ in ``budget`` bits or fewer.

    ``f``: sorted uint64. ``shared``: only positions that agree in so many leading bits are paired; each such
    path is a trie. ``prefix``: (bits, errors): at most so many errors within so many leading bits.
    ``near``: which pairs (arrays of positions) within the budget are links; all by default.
    """
    n, tally = len(f), Tally() if tally is None else tally
    forest = Forest(n)
    if n < 2:
        return []
    top = above(f, np.full(n, BITS - shared))
    cuts = np.concatenate(([0], np.flatnonzero(top[1:] != top[:-1]) + 1, [n]))
    depth, errors = prefix if prefix else (0, 0)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        open_ = forest.label[i] != forest.label[j]
        i, j = i[open_], j[open_]
        if near is not None and len(i):
            ok = near(i, j)
            i, j = i[ok], j[ok]
        forest.join(i, j)

    # Neighbours in the order of the leaves come first: they join most of a dense group, which the walk then skips.
    i = np.flatnonzero((np.bitwise_count(f[1:] ^ f[:-1]) <= budget) & (top[1:] == top[:-1]))
    if depth:
        i = i[np.bitwise_count((f[i + 1] ^ f[i]) >> np.uint64(BITS - depth)) <= errors]
    for s in range(0, len(i), CHUNK):
        meet(i[s : s + CHUNK], i[s : s + CHUNK] + 1)
    todo = [(cuts[:-1], cuts[1:], cuts[:-1], cuts[1:])]
    while todo:
        pairs = todo.pop()
        while todo and len(pairs[0]) + len(todo[-1][0]) <= CHUNK:
            pairs = tuple(np.concatenate(x) for x in zip(pairs, todo.pop(), strict=True))
        if len(pairs[0]) > CHUNK:
            todo.append(tuple(x[CHUNK:] for x in pairs))
        lo, hi, lo2, hi2 = (x[:CHUNK] for x in pairs)
        tally.visited += len(lo)
        one, two = width(f[lo] ^ f[hi - 1]), width(f[lo2] ^ f[hi2 - 1])
        bit, differ = np.maximum(one, two), f[lo] ^ f[lo2]
        far = np.bitwise_count(above(differ, bit)) > budget
        if depth:
            far |= np.bitwise_count(above(differ, np.maximum(bit, BITS - depth))) > errors
        joined = ~far & forest.settled(lo, hi, lo2, hi2)
        tally.pruned += int(far.sum())
        tally.joined += int(joined.sum())
        go = ~(far | joined)
        lo, hi, lo2, hi2, one, two, bit = (x[go] for x in (lo, hi, lo2, hi2, one, two, bit))
        leaf = bit == 0
        if leaf.any():
            tally.leaves += int(leaf.sum())
            single = leaf & (hi - lo == 1) & (hi2 - lo2 == 1)
            meet(lo[single], lo2[single])
            many = leaf & ~single
            for x, y in _expanded(lo[many], hi[many], lo2[many], hi2[many]):
                meet(x, y)
        # The node that branches higher is split; of a node with itself, both sides and the two against each other remain.
        self_ = ~leaf & (lo == lo2)
        first, second = ~leaf & ~self_ & (one >= two), ~leaf & ~self_ & (one < two)
        children = []
        for rows, a, b in ((self_, lo, hi), (first, lo, hi), (second, lo2, hi2)):
            if not rows.any():
                continue
            a, b, at = a[rows], b[rows], (np.maximum(bit[rows], 1) - 1).astype(np.uint64)
            mid = np.searchsorted(f, ((f[a] >> at) | _ONE) << at)
            if rows is self_:
                parts = [(a, mid, a, mid), (mid, b, mid, b), (a, mid, mid, b)]
            elif rows is first:
                c, d = lo2[rows], hi2[rows]
                parts = [(a, mid, c, d), (mid, b, c, d)]
            else:
                c, d = lo[rows], hi[rows]
                parts = [(c, d, a, mid), (c, d, mid, b)]
            children += parts
        if children:
            todo.append(tuple(np.concatenate(x) for x in zip(*children, strict=True)))
    return forest.edges
