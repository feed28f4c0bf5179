"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by vocabulary strings.

A piece of text is a doubly linked list of symbols. Every adjacent pair that the
merge table knows waits in a heap under (rank, place). A popped entry whose
symbols have since changed is stale and skipped; any other is merged, its right
symbol unlinked, and the two new pairs pushed.

Null text counts as empty: no ids, and the empty string when decoded. Any other
columns pass through; rows may repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import append_columns, resident, table, texts_of

#: The byte-level splitting rule of public byte-BPE tokenizers (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same rule within ASCII, for the plain engine, which is faster.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Pieces whose ids each of a worker's two caches holds.
CACHE = 400_000
#: Longer pieces aren't remembered.
CACHED_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else the next code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


#: Bits of a queue entry's place.
_PLACE = 32
_PLACES = (1 << _PLACE) - 1


class Codec:
    """A tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("a byte-level BPE file without normalizer and with plain added tokens is needed")
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        back = {ord(c): b for b, c in alphabet.items()}
        self.first = [vocab[alphabet[b]] for b in range(256)]
        #: Pairs and what becomes of them, each as one number: left and right symbol, and rank and merged symbol.
        self.merges: dict[int, int] = {}
        self.shift = max(vocab.values()).bit_length()
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[left] << self.shift | vocab[right], rank << self.shift | vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[ord(c)] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.split = regex.compile(PIECES).findall
        self.split_ascii = re.compile(ASCII_PIECES).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The symbols of a piece. A queue entry is rank and place in one number; it is stale unless the pair there still has that rank."""
        symbols = [self.first[b] for b in piece]
        n, known, shift = len(symbols), self.merges.get, self.shift
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << shift) - 1
        queue = []
        for i in range(n - 1):
            if (found := known(symbols[i] << shift | symbols[i + 1])) is not None:
                queue.append(found >> shift << _PLACE | i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & _PLACES
            j = after[i]
            left = symbols[i]
            if left < 0 or j >= n:
                continue
            found = known(left << shift | symbols[j])
            if found is None or found >> shift != entry >> _PLACE:
                continue
            whole = symbols[i] = found & mask
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := known(whole << shift | symbols[k])) is not None:
                    push(queue, found >> shift << _PLACE | i)
            h = before[i]
            if h >= 0 and (found := known(symbols[h] << shift | whole)) is not None:
                push(queue, found >> shift << _PLACE | h)
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece that the younger cache doesn't hold; a full one becomes the older, whose pieces come back when met again."""
        if (ids := self.older.get(piece)) is None:
            found = array("I", self.merge(piece.encode()))
            if sys.byteorder == "big":
                found.byteswap()
            ids = found.tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                make = self.piece
                split = self.split_ascii if part.isascii() else self.split
                out += [self.cache.get(p) or make(p) for p in split(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


def codec_of(spec: str) -> Codec:
    """One codec, with its cache, for all tasks of a Python worker, until the worker builds something else of that size."""
    return resident(("codec", spec), lambda: Codec(spec))


def tokenizer_spec(path: str | None = None) -> str:
    """A tokenizer file's text, read once by the driver; the public 50k byte-BPE where no path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False, with_bytes: bool = False, with_text: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256, and on wish ids (array<int>),
    ids_bytes (the same as little-endian unsigned 32-bit integers) and decoded (string).

    The tokenizer file (1.6 MB, whatever the data) is the only thing broadcast.
    """
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>")] * with_ids + [("ids_bytes", "binary")] * with_bytes + [("decoded", "string")] * with_text

    def factory():
        codec = codec_of(spec.value)

        def compute(batch):
            columns: list[list] = [[] for _ in fields]
            for t in texts_of(batch, text):
                ids = codec.encode(t or "")
                decoded = codec.decode(ids)
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                row += [memoryview(ids).cast("I").tolist()] * with_ids + [ids] * with_bytes + [decoded] * with_text
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            return columns

        return compute

    return append_columns(df, fields, factory)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
