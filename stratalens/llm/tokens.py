"""Hashed words and shingles of whole texts, a batch of texts at a time, in NumPy.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 text with A-Z lower-cased. A word's
hash comes from differences of one running sum over the bytes of a block, so the
cost is a few vector operations a byte and no Python object a word.

A *key* is an 8-bit frequency level above 56 bits of hash. Levels come from a
:class:`Levels` table of fixed size that counts all occurrences in the corpus by
hash bucket; keys sorted as numbers are then ordered by rarity, the same way in
every document. Buckets are shared by chance, which may cost speed, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Bytes that are worked on at once; a longer text is cut between words.
BLOCK = 1 << 18
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER = _rng.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = np.uint64((1 << 56) - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, step in enumerate((_STEP, _BACK)):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, step)], dtype=np.uint64)
    return [p[:n] for p in _powers]


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of data (uint8); no word goes on over one of breaks (places in data)."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _power(len(data))
    total = np.cumsum(_BYTE[data] * up, dtype=np.uint64)
    # spaces add nothing, so a word's sum reaches to the start of the next
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((np.append(before[1:], total[-1]) - before) * down[starts]), starts


def blocks(column: pa.Array, at_lines: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, first places and row numbers of the texts of a string column, about BLOCK bytes at once.

    A text of over a block comes in pieces cut before white space, or with
    at_lines before line feeds, each with the row's number.
    """
    texts, firsts, rows, size = [], [], [], 0

    def out():
        return np.frombuffer(b"".join(texts), np.uint8), np.array(firsts, np.int64), np.array(rows, np.int64)

    for row, x in enumerate(column.cast(pa.binary())):
        raw = x.as_py() or b""
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > BLOCK:
                end = next((k for k in range(at + BLOCK, len(raw)) if (raw[k] == 10 if at_lines else _SPACE[raw[k]])), len(raw))
            if size and size + end - at > BLOCK:
                yield out()
                texts, firsts, rows, size = [], [], [], 0
            texts.append(raw[at:end])
            firsts.append(size)
            rows.append(row)
            size += end - at
            at = end
    if size:
        yield out()


def words_by_row(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of every text that isn't empty, in order of rows."""
    row, parts = -1, []
    for data, firsts, rows in blocks(column):
        hashes, starts = word_hashes(data, firsts)
        cuts = np.searchsorted(starts, firsts)
        for k, r in enumerate(rows.tolist()):
            if r != row and parts:
                yield row, parts[0] if len(parts) == 1 else np.concatenate(parts)
                parts = []
            row = r
            parts.append(hashes[cuts[k] : cuts[k + 1] if k + 1 < len(rows) else len(hashes)])
    if parts:
        yield row, parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words, repeats included; of the whole where there are fewer; none without words."""
    k = min(n, len(words))
    if not k:
        return words
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * _ORDER[i]
    return mix(out)


class Levels:
    """Frequency levels of hash buckets: 8 * log2(1 + count), at most 255."""

    def __init__(self, counts: np.ndarray):
        self.shift = np.uint64(64 - (len(counts).bit_length() - 1))
        self.level = np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint64)
        #: What a bucket holds by chance, in occurrences.
        self.floor = float(np.median(counts))

    @staticmethod
    def level_of(count: int) -> np.uint64:
        """The level of a word that occurs so often."""
        return np.uint64(min(255, round(8 * np.log2(1.0 + count))))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return self.level[(hashes >> self.shift).astype(np.int64)] << np.uint64(56) | hashes & _HASH

    def occurrences(self, keys: np.ndarray) -> np.ndarray:
        """About how often keys occur in the corpus, beyond chance."""
        return np.maximum(0.0, 2.0 ** ((keys >> np.uint64(56)).astype(float) / 8) - 1 - 1.2 * self.floor)


def levels(texts: DataFrame, hashes_of, bits: int) -> Levels:
    """The Levels of all rows of texts (one string column); hashes_of gives the hashes of an Arrow column, in parts.

    Tasks count into one table of 2**bits, whatever the corpus' size; the tables
    are added up in slices, by two rounds of grouping.
    """
    slices, column = 64, texts.columns[0]
    width = (1 << bits) // slices

    def count(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for h in hashes_of(batch.column(batch.schema.get_field_index(column))):
                np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
        if counts.any():
            parts = counts.reshape(slices, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1].astype("int32"), "counts": [total.tobytes()]})

    schema = "slice int, counts binary"
    parts = texts.mapInArrow(tidy(count), schema).withColumn("some", F.spark_partition_id() % 8)
    summed = parts.groupBy("slice", "some").applyInPandas(lambda pdf: add(pdf), schema).groupBy("slice").applyInPandas(lambda pdf: add(pdf), schema)
    counts = np.zeros((slices, width), np.int64)
    for r in summed.collect():  # 2**bits numbers
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return Levels(counts.reshape(-1))
