"""Alignment of two tokenizers' tokens, and the pairs of ids that stand for the same bytes.

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B), whose tokens both spell out the bytes of the text
with a space before it. In a task, the cumulative ends of both are merged like two sorted lists, each pointer only
moving forward: where both end, a group ends. All pairs of tokens of a group are links. A task gives a row per document with
its groups, and its distinct id pairs with the number of times each is linked; Spark groups the pairs, counts their documents, finds
for each id the most frequent partner, and joins this back to the documents' pairs.

A pair that most documents hold would be a hot key of that join: the most frequent pairs, as many as the broadcast bound
allows, are joined by broadcast, and only the rest, each in fewer documents, by shuffle.

Defined results: texts that are null or empty, and texts whose joined tokens of either side differ from a space and the text, have
no tokens (zeros, and an empty digest); strings of special tokens are plain text; repeated rows count as one document each; an
empty table gives no rows; further columns are ignored. Texts are never cut; the links of a group are made in bounded parts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, slices, stage
from .packing import REMEMBERED, Ids
from .tokencount import byte_chars

#: Links that are held at once.
LINKS = 1 << 22
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<int>"


class PlainIds(Ids):
    """Token ids of a byte-level vocabulary file; strings of special tokens are plain text."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        coder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda text: coder.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.spelled[i] = token
        self.opens = np.array([t.startswith(b" ") for t in self.spelled])
        self.remembered, self.known = remembered, {"": self.encode(" ").tobytes()}


class Pieces:
    """Token ids of a piece vocabulary file, and the bytes that each spells out."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def batch(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


def merged_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two strictly increasing arrays of ends agree: for each token of either, whether it ends a group."""
    # The stable sort of two sorted runs is their merge: linear, and equal ends come to stand side by side, a's first.
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    agree = np.flatnonzero(both[order][1:] == both[order][:-1])
    ends_a, ends_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    ends_a[order[agree]], ends_b[order[agree + 1] - len(a)] = True, True
    return ends_a, ends_b


class Aligner:
    """Groups and links of the texts of a batch under two vocabulary files."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = PlainIds(path_a), Pieces(path_b)
        self.sizes = [np.array([len(t) for t in side.spelled], dtype=np.int64) for side in (self.a, self.b)]
        self.width = len(self.b.spelled)
        names = [str(i) for i in range(max(len(self.a.spelled), self.width))]
        # Each id with the sign that may follow it.
        self.most, self.shown = len(names), [n + sign for sign in ",|;" for n in names]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both id arrays of each text; None if it has no tokens."""
        out = []
        for text, a, b in zip(texts, self.a.batch([" " + t for t in texts]), self.b.batch(texts), strict=True):
            a, whole = np.frombuffer(a, dtype="<u4").astype(np.int64), (" " + text).encode()
            fits = text != "" and all(b"".join(map(side.spelled.__getitem__, ids)) == whole for side, ids in ((self.a, a.tolist()), (self.b, b)))
            out.append((a, np.array(b, dtype=np.int64)) if fits else None)
        return out

    def aligned(self, texts: list[str], whole: bool) -> dict[str, list]:
        """The columns of ``ALIGNED`` after the ids."""
        found = self.encoded(texts)
        at = [i for i, f in enumerate(found) if f is not None]
        out = {c: [0] * len(texts) for c in FIGURES} | {"groups": [None] * len(texts), "groups_sha256": [""] * len(texts), "pairs": [[] for _ in texts], "times": [[] for _ in texts]}
        if not at:
            return out
        ids = [np.concatenate([found[i][s] for i in at]) for s in (0, 1)]
        counts = [np.array([len(found[i][s]) for i in at]) for s in (0, 1)]
        a, b = ids
        # The texts' bytes lie one after the other, and both sides end where a text does.
        ends_a, ends_b = merged_ends(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        n_groups = int(ends_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        doc_a = np.repeat(np.arange(len(at)), counts[0])
        doc_of = doc_a[ends_a]
        per_doc = lambda x: np.bincount(doc_of, weights=x, minlength=len(at)).astype(np.int64).tolist()
        for name, values in zip(FIGURES, (counts[0].tolist(), counts[1].tolist(), per_doc(None), per_doc(in_a * in_b)), strict=True):
            for i, v in zip(at, values, strict=True):
                out[name][i] = v
        # A group shows its A ids, then its B ids.
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        shown[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + self.most * ends_a
        shown[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = b + 2 * self.most * ends_b
        last = np.cumsum(counts[0] + counts[1])
        for i, lo, hi in zip(at, (last - counts[0] - counts[1]).tolist(), last.tolist(), strict=True):
            text = "".join(map(self.shown.__getitem__, shown[lo:hi].tolist()))[:-1]
            out["groups_sha256"][i] = hashlib.sha256(text.encode()).hexdigest()
            if whole:
                out["groups"][i] = text
        keys, times = self._pairs(a, b, group_a, in_b, doc_a)
        span = len(self.a.spelled) * self.width
        starts = np.searchsorted(keys, np.arange(len(at) + 1) * span)
        for k, i in enumerate(at):
            out["pairs"][i], out["times"][i] = keys[starts[k] : starts[k + 1]] - k * span, times[starts[k] : starts[k + 1]]
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, in_b: np.ndarray, doc_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, a, b) as one number each, sorted, and how often each is linked. Links are made some at a time."""
        partners, first = in_b[group_a], (np.cumsum(in_b) - in_b)[group_a]
        base = (doc_a * len(self.a.spelled) + a) * self.width
        made, kept, done = np.cumsum(partners), [], 0
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(made, (made[done - 1] if done else 0) + LINKS, side="right")))
            n, part = partners[done:upto], slice(done, upto)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            kept.append(np.unique(np.repeat(base[part], n) + b[np.repeat(first[part], n) + inner], return_counts=True))
            done = upto
        if len(kept) == 1:
            return kept[0]
        keys, where = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([c for _, c in kept])).astype(np.int64)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, whole: bool = False) -> DataFrame:
    """A row per row of ``docs``: its figures, its groups as text (if ``whole``) and their digest, and its id pairs with their numbers.

    A pair is ``a * size of B + b``. ``row`` tells rows apart, but only a written table keeps it.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            for part in slices(texts):
                found = both.aligned(texts[part], whole)
                k = len(texts[part])
                yield pd.DataFrame({"row": np.arange(n, n + k), "doc_id": frame["doc_id"].iloc[part].to_numpy(), **found})
                n += k

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(of, ALIGNED)


def counted(aligned: DataFrame, width: int) -> DataFrame:
    """pair, n, best_a, best_b of each id pair: how many documents hold it linked, and whether this is the most of its A id, of its B id."""
    a, b = F.floor(F.col("pair") / width), F.col("pair") % width
    counts = stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).select("pair", a.alias("a"), b.alias("b"), "n"))
    for side in ("a", "b"):
        # No more rows than ids in the vocabulary.
        most = counts.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
        counts = counts.join(F.broadcast(most), side)
    return counts.select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def frequent(counts: DataFrame, most: int = BROADCAST_ROWS) -> int | None:
    """The least number of documents of which at most ``most`` pairs have as many; None if that holds for all pairs.

    Numbers are looked at by their powers of 2^(1/8).
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    total, least = 0, None
    found = {r["step"]: (r["rows"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()}
    for s in sorted(found, reverse=True):
        total += found[s][0]
        if total > most:
            return least if least is not None else 2**62
        least = found[s][1]
    return None


def figures(docs: DataFrame, path_a: str, path_b: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """A row per row of ``docs``: tokens, groups and links, the links to the A id's most frequent partners, and the sum of the pairs' counts."""
    width = len(Pieces(path_b).spelled)
    rows = stage(align(docs, path_a, path_b))
    counts = stage(counted(rows, width).select("pair", "n", "best_a"))
    pairs = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    sums = [F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    limit = frequent(counts, most)
    often = F.broadcast(counts if limit is None else counts.where(F.col("n") >= limit))
    found = pairs.join(often, "pair").groupBy("row").agg(*sums)
    if limit is not None:
        seldom = counts.where(F.col("n") < limit).hint("merge")
        found = found.unionByName(pairs.join(often.select("pair"), "pair", "left_anti").join(seldom, "pair").groupBy("row").agg(*sums))
        found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("row", "doc_id", *FIGURES, "groups_sha256").join(found, "row", "left").select("doc_id", *FIGURES, zero("n_best"), zero("count_sum"), "groups_sha256")


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return figures(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
