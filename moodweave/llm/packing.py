"""Packing documents into token sequences by a linear grouping scheme.

Documents are tokenized and cut into pieces once. All that the plan needs is how many pieces have
each length, at most ``capacity`` counts. On these counts, large lengths are split into groups of
equal cardinality and rounded up to the group's largest; a small integer programme over the few
rounded sizes is solved by column generation; actual pieces take the places of the rounded ones,
and small pieces go, longest first, where they fit best. The plan is a list of runs, "the pieces
number a to b of length l start sequences s, s+1, ... at offset o"; pieces are numbered within
their length across the cluster and look their run up.

Defined results: a null text is empty and packs as one piece, the closing id alone; repeated rows
are packed one by one; an empty table packs nothing; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, slices
from .tokencount import byte_chars

CAPACITY = 2048
#: The id that closes each document.
CLOSE = 0
#: Groups of large lengths, and the share of the capacity above which a length is large.
GROUPS, LARGE = 80, 0.125
REMEMBERED = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Token ids of texts as bytes (little-endian, 32 bits), for a byte-level vocabulary file.

    A text is cut before single spaces, where no pre-token of such a vocabulary ever runs across,
    and the ids of each part are remembered in a bounded table.
    """

    #: White space in a row of which a pre-token could run across a cut.
    unsafe = re.compile(r"\s (?!\S)")

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        coder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.encode = lambda text: coder.encode_to_numpy(text, allowed_special="all").astype("<u4")
        # The tokens that begin with a space: in a row of words, the first of each word.
        self.opens = np.zeros(coder.n_vocab, dtype=bool)
        self.opens[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.remembered, self.known = remembered, {"": self.encode(" ").tobytes()}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > self.remembered:
            self.known = {"": self.known[""]}
        bare = [w for w in words if w.strip() == w]
        if bare:
            found = self.encode(" " + " ".join(bare))
            ends = [*(4 * np.flatnonzero(self.opens[found])[1:]).tolist(), 4 * len(found)]
            data, start = found.tobytes(), 0
            for w, end in zip(bare, ends, strict=True):
                self.known[w] = data[start:end]
                start = end
        for w in words.difference(bare):
            self.known[w] = self.encode(" " + w).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        safe = [None if self.unsafe.search(t) else t.split(" ") for t in texts]
        out, done, new = [], 0, set()
        for i, parts in enumerate(safe):
            new.update(parts[1:] if parts else ())
            if len(new) > 20_000 or i == len(safe) - 1:
                # All words of these texts are learnt together, as learning may forget the others.
                self._learn(new if len(self.known) > self.remembered else new.difference(self.known))
                for text, words in zip(texts[done : i + 1], safe[done : i + 1], strict=True):
                    if words is None:
                        out.append(self.encode(text).tobytes())
                    else:
                        out.append(self.encode(words[0]).tobytes() + b"".join(map(self.known.__getitem__, words[1:])))
                done, new = i + 1, set()
        return out


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    return Ids(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all are full but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each document of ``docs``: doc_id, piece, start, length, ids_crc32."""

    def tokenized(batches):
        coder = ids(path)
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            # Only a bounded part of a batch is held as words and ids at once.
            found = chain.from_iterable(coder.batch(texts[part]) for part in slices(texts))
            for doc_id, data in zip(batch["doc_id"].array, found, strict=True):
                data += CLOSE.to_bytes(4, "little")
                key = None if pd.isna(doc_id) else int(doc_id)
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    rows.append((key, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tokenized, PIECES)


def grouped(counts: dict[int, int], least: int, groups: int) -> list[list[int]]:
    """Large lengths, longest first, in groups of (nearly) equal numbers of pieces, as [rounded size, pieces]."""
    large = [(n, c) for n, c in sorted(counts.items(), reverse=True) if n > least]
    total = sum(c for _, c in large)
    size, out, room = -(-total // groups) if total else 0, [], 0
    for n, c in large:
        while c:
            if not room:
                out.append([n, 0])
                room = size
            took = min(room, c)
            out[-1][1] += took
            room, c = room - took, c - took
    merged: dict[int, int] = defaultdict(int)
    for n, c in out:
        merged[n] += c
    return [[n, c] for n, c in sorted(merged.items(), reverse=True)]


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of one sequence with the largest value: an unbounded knapsack over the sizes."""
    best, chose = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = [(int(s), float(v), i) for i, (s, v) in enumerate(zip(sizes, values, strict=True)) if v > 0]
    order = np.array([i for s, v, i in sorted(fits)], dtype=np.int64)
    weight, value = sizes[order], values[order]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := int(np.searchsorted(weight, room, side="right")):
            filled = best[room - weight[:n]] + value[:n]
            at = int(filled.argmax())
            if filled[at] > best[room] + 1e-12:
                best[room], chose[room] = filled[at], order[at]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if chose[room] < 0:
            room -= 1
        else:
            pattern[chose[room]] += 1
            room -= int(sizes[chose[room]])
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 300) -> list[tuple[list[int], int]]:
    """(pieces of each size, how many sequences) that meet the demand with few sequences.

    Column generation: a revised simplex over one pattern per size, prices from its dual values and
    new patterns from the knapsack; whole multiples are then taken and the rest is filled first-fit.
    """
    k = len(sizes)
    if not k:
        return []
    size, need = np.array(sizes), np.array(demand, dtype=float)
    basis = [np.eye(k, dtype=np.int64)[i] * (capacity // s) for i, s in enumerate(sizes)]
    for _ in range(rounds):
        matrix = np.array(basis, dtype=float).T
        dual = np.linalg.solve(matrix.T, np.ones(k))
        value, pattern = best_pattern(dual, size, capacity)
        if value <= 1 + 1e-7:
            break
        step, level = np.linalg.solve(matrix, pattern.astype(float)), np.linalg.solve(matrix, need)
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[int(np.argmin(ratio))] = pattern
    level = np.linalg.solve(np.array(basis, dtype=float).T, need)
    left, out = np.array(demand, dtype=np.int64), []
    for pattern, x in sorted(zip(basis, level, strict=True), key=lambda p: -p[1]):
        used = [i for i in range(k) if pattern[i]]
        times = min(int(x + 1e-6), *(int(left[i] // pattern[i]) for i in used)) if used else 0
        if times > 0:
            left -= pattern * times
            out.append((pattern.tolist(), times))
    while left.any():  # fewer sequences than there are sizes, or so
        room, pattern = capacity, np.zeros(k, dtype=np.int64)
        for i in range(k):
            pattern[i] = min(left[i], room // size[i])
            room -= int(pattern[i] * size[i])
        times = min(int(left[i] // pattern[i]) for i in range(k) if pattern[i])
        left -= pattern * times
        out.append((pattern.tolist(), times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> pd.DataFrame:
    """Runs of pieces (length, first, n, sequence_id, offset) from the number of pieces of each length.

    The piece number ``first + j`` of a length goes to ``sequence_id + j`` at ``offset``.
    """
    counts = {n: c for n, c in counts.items() if c}
    least = int(capacity * large)
    sized = grouped({n: c for n, c in counts.items() if n < capacity}, least, groups)
    runs: list[tuple[int, int, int, int, int]] = []
    given: dict[int, int] = defaultdict(int)  # pieces of each length placed so far
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    following = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, given[length], n, sequence, offset))
        given[length] += n

    if full := counts.get(capacity, 0):
        place(capacity, full, 0, 0)
        following = full
    # Actual pieces, longest first, take the places of their rounded size.
    queue, lengths = [[n, c] for n, c in sorted(counts.items(), reverse=True) if least < n < capacity], 0
    stock: list[list[list[int]]] = []
    for _, c in sized:
        own = []
        while c:
            took = min(c, queue[lengths][1])
            own.append([queue[lengths][0], took])
            queue[lengths][1] -= took
            lengths += not queue[lengths][1]
            c -= took
        stock.append(own)
    for pattern, times in configurations([n for n, _ in sized], [c for _, c in sized], capacity):
        slots = [i for i, m in enumerate(pattern) for _ in range(m)]
        while times:
            # So many sequences alike as the stock of actual lengths allows.
            need: dict[int, int] = defaultdict(int)
            for i in slots:
                need[i] += 1
            whole = {i: stock[i][0][1] // m for i, m in need.items()}
            n, offset = min(times, *whole.values()) or 1, 0
            for i in slots:
                length = stock[i][0][0]
                place(length, n, following, offset)
                offset += length
                stock[i][0][1] -= n
                if not stock[i][0][1]:
                    stock[i].pop(0)
            free[capacity - offset].append((following, n))
            following, times = following + n, times - n
    rooms = sorted(r for r in free if r)
    # Best fit for the rest: the least room that holds the piece.
    for length in sorted((n for n in counts if n <= least), reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = capacity // length
                n = -(-left // each)
                free[capacity].append((following, n))
                following += n
                room = capacity
                if capacity not in rooms:
                    rooms.append(capacity)
            else:
                room = rooms[at]
            sequence, n = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.remove(room)
            # What is left of a room is a better fit for the next such piece than any other room.
            each = room // length
            used = min(n, left // each)
            if not used:
                each, used = left, 1
            for j in range(each):
                place(length, used, sequence, capacity - room + j * length)
            left -= each * used
            for rest, m, s in ((room, n - used, sequence + used), (room - each * length, used, sequence)):
                if m and rest:
                    if rest not in free:
                        rooms.insert(bisect_right(rooms, rest), rest)
                    free[rest].append((s, m))
    return pd.DataFrame(runs, columns=["length", "first", "n", "sequence_id", "offset"])


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with the column ``length`` (1 to ``capacity``)."""
    numbered = gapless(cuts, ["length"], "_number")
    # At most ``capacity`` rows come to the driver, whatever the number of pieces.
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    by_length = {n: (g["first"].to_numpy(), g["sequence_id"].to_numpy(), g["offset"].to_numpy()) for n, g in runs.groupby("length")}
    shared = cuts.sparkSession.sparkContext.broadcast(by_length)

    @F.pandas_udf("sequence_id long, offset long")
    def located(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        table, n, k = shared.value, length.to_numpy(), number.to_numpy()
        seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for size in np.unique(n):
            first, sequence, offset = table[int(size)]
            rows = np.flatnonzero(n == size)
            run = np.searchsorted(first, k[rows], side="right") - 1
            seq[rows], off[rows] = sequence[run] + k[rows] - first[run], offset[run]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return numbered.withColumn("_place", located("length", "_number")).select(*cuts.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
