"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array. In every round each sequence finds its
lowest-rank pair and all sequences merge all occurrences of theirs at once; the symbols that survive
are counted. Words already counted are looked up in a bounded table.

Defined results: a null text is empty (0 bytes, 0 tokens); repeated rows are counted alike; empty
tables give no rows; further columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, slices

#: Words that a worker remembers at most; the table starts anew beyond it.
REMEMBERED = 500_000
NONE = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies (a public convention)."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class RankMerger:
    """Counts the tokens of byte sequences under a merge table whose words end in a suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols that survive for each word; an empty word has none."""
        if not words:
            return np.zeros(0, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out, alive = sizes.copy(), np.flatnonzero(sizes > 1)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        sym = self.first[data]
        sym[ends[sizes > 0] - 1] = self.last[data[ends[sizes > 0] - 1]]
        keep = np.repeat(sizes > 1, sizes)
        sym, lens = sym[keep], sizes[alive]
        while len(alive):
            starts = np.cumsum(lens) - lens
            rank = self._ranks(sym, starts, lens)
            best = np.minimum.reduceat(rank, starts)
            going = best < NONE
            if not going.all():  # the others are done
                out[alive[~going]] = lens[~going]
                stay = np.repeat(going, lens)
                sym, rank, alive, lens, best = sym[stay], rank[stay], alive[going], lens[going], best[going]
                if not len(alive):
                    break
            hit = rank == np.repeat(best, lens)
            hit = self._leftmost(hit)
            sym[hit] = self.made[rank[hit]]
            gone = np.zeros(len(sym), dtype=bool)
            gone[1:] = hit[:-1]
            lens = lens - np.add.reduceat(gone.astype(np.int64), np.cumsum(lens) - lens)
            sym = sym[~gone]
            single = lens == 1
            if single.any():
                out[alive[single]] = 1
                sym, alive, lens = sym[np.repeat(~single, lens)], alive[~single], lens[~single]
        return out

    def _ranks(self, sym: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol; NONE for no pair."""
        key = np.full(len(sym), -1, dtype=np.int64)
        key[:-1] = sym[:-1] * self.base + sym[1:]
        key[starts + lens - 1] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of adjacent hits (a symbol paired with itself) every other one, from the left."""
        if not (hit[1:] & hit[:-1]).any():
            return hit
        at = np.arange(len(hit))
        run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), at, 0))
        return hit & ((at - run_start) % 2 == 0)


class TextCounter:
    """Counts the tokens of texts for a lower-casing, white-space dropping word vocabulary file."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.merger = RankMerger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(r"\n|" + split).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.gaps = regex.compile(r"\p{White_Space}+")
        self.remembered, self.known, self.pieces = remembered, {}, {}

    @staticmethod
    def _normal(text: str) -> str:
        # Character by character: no special form for a sigma at the end.
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _learn(self, words: set[str]) -> None:
        """Count new words, all in one string: a line feed, which no word holds, ends each word."""
        words = list(words)
        fixed, parts = np.zeros(len(words), dtype=np.int64), words
        if self.special and self.special.search("\n".join(words)):
            # A special string is one token; what stands beside it is counted apart.
            fixed += [len(self.special.findall(w)) for w in words]
            parts = [self.special.sub(" ", w) for w in words]
        pieces = self.parts(self._normal("\n".join(parts)))
        if len(self.pieces) > self.remembered:
            self.pieces.clear()
        self.pieces["\n"] = -1
        unique = list(set(pieces).difference(self.pieces))
        self.pieces.update(zip(unique, self.merger.count([u.encode() for u in unique]).tolist(), strict=True))
        found = np.fromiter(map(self.pieces.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        owner = np.cumsum(found < 0)
        fixed += np.bincount(owner, weights=np.maximum(found, 0), minlength=len(words)).astype(np.int64)[: len(words)]
        self.known.update(zip(words, fixed.tolist(), strict=True))

    def words(self, text: str) -> list[str]:
        """White-space separated words; separators \\x1c to \\x1f are symbols here, not white space."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in self.gaps.split(text) if w]
        return text.split()

    def count(self, texts: list[str]) -> list[int]:
        out, done = [0] * len(texts), 0
        split: list[list[str]] = []
        new: set[str] = set()
        for i, text in enumerate(texts):
            split.append(self.words(text))
            new |= set(split[-1]).difference(self.known)
            if len(new) > 20_000 or i == len(texts) - 1:
                # Learning may forget the rest, so all words of these texts are learnt together then.
                if len(self.known) + len(new) > self.remembered:
                    self.known.clear()
                    new = set().union(*split)
                self._learn(new)
                for j, words in enumerate(split, done):
                    out[j] = sum(map(self.known.__getitem__, words))
                done, split, new = i + 1, [], set()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_tokens(docs: DataFrame, path: str, name: str = "n_tokens", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, ``name`` and over_limit for each row of ``docs``. ``path``: the vocabulary file on every executor."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        whole, book = [t or "" for t in texts], counter(path)
        # Only a bounded part of a batch is held as words at once.
        return pd.Series([n for part in slices(whole) for n in book.count(whole[part])], dtype="int64")

    text = plain(F.col("text"))
    return (
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias(name))
        .withColumn("over_limit", F.col(name) > limit)
    )


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
