"""N-grams of many texts counted as arrays: a text is looked at once, and its n-grams never become rows.

Units are the characters of a text, or its words. They are numbered within a part of a batch, and an n-gram is the number that its units' numbers
make side by side, behind that of its document: one sort then counts the n-grams of all documents of a part. Parts are halved
until such numbers fit 63 bits; a text that holds too many different units by itself is counted as strings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that are looked at together.
UNITS = 1 << 19
BITS = 63
SEPARATOR = {"word": " ", "char": ""}


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Texts of a column of arrays of texts: the row of each, and the texts."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), column.flatten()


def _units(kind: str, texts: pa.Array) -> tuple[np.ndarray, pa.Array | np.ndarray]:
    """Units of each text, and the units: words as strings, characters as code points. Nulls are empty texts."""
    if kind == "word":
        return pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), texts.flatten()
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.frombuffer("".join(pc.fill_null(texts, "").to_pylist()).encode("utf-32-le"), "<u4")


def _numbered(kind: str, units: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each unit, from 1, and the different units."""
    if kind == "word":
        found = units.dictionary_encode()
        return found.indices.to_numpy().astype(np.int64) + 1, found.dictionary
    number = np.zeros(0x110000, np.int64)
    number[units] = 1
    different = np.flatnonzero(number)
    number[different] = np.arange(1, len(different) + 1)
    return number[units], pa.array([chr(c) for c in different.tolist()], pa.string())


class Vocabulary:
    """Terms by their place, and what they are made of."""

    def __init__(self, kind: str, terms: list[str], high: int) -> None:
        self.terms = terms
        made = [t.split(" ") if kind == "word" else list(t) for t in terms]
        own: dict[str, int] = {}
        self.made = np.zeros((len(terms), high), np.int32)
        for i, units in enumerate(made):
            for j, u in enumerate(units, high - len(units)):
                self.made[i, j] = own.setdefault(u, len(own) + 1)
        self.own = list(own)

    def keys(self, different: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers of the terms under a part's numbering, and their places; terms with units that the part lacks are left out."""
        at = pc.fill_null(pc.index_in(pa.array(self.own, pa.string()), value_set=different), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        units = np.concatenate((np.zeros(1, np.int64), at))[self.made]
        there = np.flatnonzero(((units > 0) | (self.made == 0)).all(axis=1))
        key = _side_by_side(units[there].T, bits)
        order = np.argsort(key)
        return key[order], there[order]


def _side_by_side(columns, bits: int) -> np.ndarray:
    out = 0
    for c in columns:
        out = (out << bits) | c
    return out


def _strings(keys: np.ndarray, bits: int, high: int, different: pa.Array, separator: str) -> pa.Array:
    columns = []
    for j in range(high):
        number = (keys >> (bits * (high - 1 - j))) & ((1 << bits) - 1)
        columns.append(different.take(pa.array(number - 1, mask=number == 0)))
    return pc.binary_join_element_wise(*columns, separator, null_handling="skip")


def _parts(kind: str, texts: pa.Array, rows: np.ndarray, low: int, high: int) -> Iterator[tuple]:
    """(rows, keys, tf, bits, different units) of parts of the texts; for texts that fit no number (row, None, tf, None, terms).

    ``rows`` (not falling) tells the document of each text. A document of several texts is never divided.
    """
    sizes, units = _units(kind, texts)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first = np.concatenate((np.flatnonzero(np.diff(rows, prepend=-1)), [len(rows)])) if len(rows) else np.zeros(1, np.int64)
    todo, begin = [], 0
    while begin < len(first) - 1:
        end = max(begin + 1, int(np.searchsorted(starts[first], starts[first[begin]] + UNITS, side="right")) - 1)
        todo.append((begin, end))
        begin = end
    while todo:
        begin, end = todo.pop()
        a, b = first[begin], first[end]
        mine = units[starts[a] : starts[b]]
        if not len(mine):
            continue
        number, different = _numbered(kind, mine)
        bits, doc_bits = len(different).bit_length(), (end - begin - 1).bit_length()
        if bits * high + doc_bits > BITS:
            if end - begin > 1:
                todo += [((begin + end) // 2, end), (begin, (begin + end) // 2)]
            else:
                names, counts = different.to_pylist(), Counter()
                for i, size in zip((starts[a:b] - starts[a]).tolist(), sizes[a:b].tolist(), strict=True):
                    own = [names[k - 1] for k in number[i : i + size].tolist()]
                    counts.update(SEPARATOR[kind].join(own[k : k + n]) for n in range(low, high + 1) for k in range(size - n + 1))
                yield np.full(len(counts), rows[a]), None, np.array(list(counts.values()), np.int64), None, pa.array(list(counts), pa.string())
            continue
        text = np.repeat(np.arange(b - a), sizes[a:b])
        doc = (np.cumsum(np.diff(rows[a:b], prepend=rows[a]) > 0) << (bits * high))[text]
        key, found = np.zeros(len(number), np.int64), []
        for n in range(1, high + 1):
            if n > len(number):
                break
            key = (key[: len(number) - n + 1] << bits) | number[n - 1 :]
            if n >= low:
                inside = text[: len(key)] == text[n - 1 :]
                found.append((key | doc[: len(key)])[inside])
        whole = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if not len(whole):
            continue
        at = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
        tf, whole = np.diff(at, append=len(whole)), whole[at]
        docs = rows[first[begin:end]]
        yield docs[whole >> (bits * high)], whole & ((1 << (bits * high)) - 1), tf, bits, different


def totals(kind: str, texts: pa.Array, rows: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """term, df, ctf of the documents, a batch a part; terms come back in other batches."""
    for _, keys, tf, bits, different in _parts(kind, texts, rows, low, high):
        if keys is None:
            terms, df, ctf = different, np.ones(len(tf), np.int64), tf
        else:
            order = np.argsort(keys)
            keys, tf = keys[order], tf[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            df, ctf = np.diff(at, append=len(keys)), np.add.reduceat(tf, at)
            terms = _strings(keys[at], bits, high, different, SEPARATOR[kind])
        yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(ctf, pa.int64())], ["term", "df", "ctf"])


def placed(kind: str, texts: pa.Array, rows: np.ndarray, low: int, high: int, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, places in the vocabulary and counts of the terms that it holds, in their order, a part after the other; no row is in two parts."""
    for docs, keys, tf, bits, different in _parts(kind, texts, rows, low, high):
        if keys is None:
            place = pc.fill_null(pc.index_in(different, value_set=pa.array(vocabulary.terms, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = place >= 0
        else:
            mine, places = vocabulary.keys(different, bits)
            if not len(mine):
                continue
            at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
            known, place = mine[at] == keys, places[at]
        docs, place, tf = docs[known], place[known], tf[known]
        order = np.lexsort((place, docs))
        yield docs[order], place[order], tf[order]


def weighed(docs: np.ndarray, place: np.ndarray, tf: np.ndarray, idf: np.ndarray, sublinear: bool) -> np.ndarray:
    """tf times idf, each document (rows side by side) scaled to length 1."""
    w = ((1.0 + np.log(tf)) if sublinear else tf.astype(float)) * idf[place]
    if not len(w):
        return w
    at = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    norm = np.sqrt(np.add.reduceat(w * w, at))
    return w / np.repeat(norm, np.diff(at, append=len(w)))
