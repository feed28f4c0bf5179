"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of digits, a-z (A-Z lower-cased) and all code points from U+0080.
An item's windows are its runs of WINDOW consecutive words; an item of fewer
words, but not none, is one window. The automaton knows every word of the items by a
number of a few letters. A window of 2k - 1 words holds a whole one of the item's pieces of k
words that begin at multiples of k, so the automaton holds those pieces alone (and
short items whole): it is as long as the items, not WINDOW times that. A document
passes through it once; where a piece occurs, the few windows that could hold it are
looked up in the table of the items' windows, each place of the document once at most,
so the time is in proportion to the document, however periodic or alike the items are.
Word numbers map back to code points of the original text.

Null or empty texts have no words, no hits, and are not contaminated; items
without words or without id have no windows. Rows may repeat, other columns pass
through. Benchmark texts are the stated query set: they go to the executors in
blocks of at most BLOCK_BYTES, one automaton after another, however large the
benchmark is; a worker builds each once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, append_columns, bytes_of, fresh, resident, table

WINDOW = 13
#: A document is contaminated if at least one word in CONTAMINATED_PART is hit.
CONTAMINATED_PART = 20
#: Most bytes of item text in one automaton and its table of windows.
BLOCK_BYTES = 2 << 20

#: A-Z to a-z, other ASCII than digits and letters to a space.
NORMAL = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
#: A letter of words that no item has.
OTHER = "\0"
#: Bits of a letter: the automaton looks at a node's children one by one.
DIGIT = 5


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Passages:
    """The automaton of items (id, text): which words of a document are in windows of theirs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.piece = window, (window + 1) // 2
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            if words := words_of(text):
                owners.setdefault(tuple(words), set()).add(item)
        numbers: dict[bytes, int] = {}
        for words in owners:
            for w in words:
                numbers.setdefault(w, len(numbers))
        self.width = max(1, -(-len(numbers).bit_length() // DIGIT))
        self.other = OTHER * self.width
        self.codes = {w: self._code(n) for w, n in numbers.items()}
        #: of every window of the items, short items whole: the item words that have it; equal lists are one
        self.windows: dict[str, tuple[int, ...]] = {}
        self.owners = [tuple(sorted(x)) for x in owners.values()]
        pieces: dict[str, bool] = {}  # whether it is a short item
        held: dict[str, list[int]] = {}
        for number, words in enumerate(owners):
            item = "".join(self.coded(words))
            size = len(words)
            for at in range(max(1, size - window + 1)):
                of = held.setdefault(item[at * self.width : (at + window) * self.width], [])
                if not of or of[-1] != number:
                    of.append(number)
            if size < window:
                pieces[item] = True
            else:
                for at in range(0, size - self.piece + 1, self.piece):
                    pieces.setdefault(item[at * self.width : (at + self.piece) * self.width], False)
        same: dict[tuple[int, ...], tuple[int, ...]] = {}
        while held:
            text, of = held.popitem()
            self.windows[text] = same.setdefault(tuple(of), tuple(of))
        self.automaton = ahocorasick.Automaton()
        for piece, short in pieces.items():
            self.automaton.add_word(piece, (len(piece) // self.width, short))
        if pieces:
            self.automaton.make_automaton()

    def _code(self, number: int) -> str:
        """width letters of DIGIT bits, those of each place another alphabet, so that no word is found inside of others."""
        return "".join(chr(1 + (k << DIGIT) + (number >> DIGIT * k & (1 << DIGIT) - 1)) for k in range(self.width))

    def coded(self, words: Iterable[bytes]) -> list[str]:
        codes, other = self.codes, self.other
        return [codes.get(w, other) for w in words]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The runs [start, end) of words that are hit, in any order, and the items whose windows occur.

        Every window is looked up once at most, whatever the items share or repeat.
        """
        hits: list[tuple[int, int]] = []
        found: set[tuple[int, ...]] = set()
        if not self.windows or not words:
            return hits, set()
        text, width, window, known = "".join(self.coded(words)), self.width, self.window, self.windows
        reach, following = window - self.piece, 0  # the first window that is not looked up yet

        def hit(a: int, b: int) -> None:
            if hits and hits[-1][0] <= a <= hits[-1][1]:
                hits[-1] = hits[-1][0], max(b, hits[-1][1])
            else:
                hits.append((a, b))

        for last, (size, short) in self.automaton.iter(text):
            start = last // width - size + 1
            if short:
                found.add(known[text[start * width : (start + size) * width]])
                hit(start, start + size)
            if size == self.piece:
                for at in range(max(following, start - reach), min(start, len(words) - window) + 1):
                    of = known.get(text[at * width : (at + window) * width])
                    if of is not None:
                        found.add(of)
                        hit(at, at + window)
                following = max(following, start + 1)
        return hits, {x for of in found for number in of for x in self.owners[number]}


def passages_of(key: bytes, items: list[tuple[str, bytes]], window: int) -> Passages:
    """One automaton for all tasks of a Python worker, until the worker builds another."""
    return resident(("passages", key, window), lambda: Passages(items, window))


def pieces_of(text: bytes, most: int, window: int) -> Iterator[bytes]:
    """text, or where it is longer than most bytes, overlapping parts of it that have all its windows."""
    words = words_of(text) if len(text) > most else []
    if len(words) <= window:
        yield text
        return
    start = 0
    while True:
        end, size = start, 0
        while end < len(words) and (end - start < window or size + len(words[end]) < most):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[start:end])
        if end == len(words):
            return
        start = end - window + 1


def in_blocks(items: list[tuple[str, bytes]], most: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """items in blocks of at most about most bytes of text."""
    block, size = [], 0
    for item, text in items:
        for piece in pieces_of(text, most, window):
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    if block:
        yield block


def hit_runs(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching [start, end) pairs put together."""
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(df: DataFrame, text: str, items: list[tuple[str, bytes]], window: int, spans: bool, runs: str, names: str) -> DataFrame:
    """df with runs (starts and ends of hits, one after another) and names of items, what they were before included, and the document's figures."""
    key = hashlib.sha256(repr(items).encode()).digest()
    block = df.sparkSession.sparkContext.broadcast(items)
    before = runs in df.columns
    fields = [(runs, "array<int>"), (names, "array<string>"), ("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")]
    fields += [("hit_spans", "array<struct<start:int,end:int>>")] * spans

    def factory():
        passages = passages_of(key, block.value, window)

        def compute(batch):
            old = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (runs, names)), strict=True) if before else iter(lambda: ((), ()), 0)
            columns: list[list] = [[] for _ in fields]
            for raw, (ends, owners) in zip(bytes_of(batch, text), old, strict=False):
                words = words_of(raw)
                hits, ids = passages.find(words)
                hits = hit_runs(hits + [*zip(ends[::2], ends[1::2], strict=True)])
                n_hit = sum(b - a for a, b in hits)
                ids = sorted(ids.union(owners))
                row = [[x for run in hits for x in run], ids, len(words), n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0 and CONTAMINATED_PART * n_hit >= len(words)]
                if spans:
                    places = [m.span() for m in WORD.finditer(raw.decode())] if hits else []
                    row.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in hits])
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            return columns

        return compute

    return append_columns(df, fields, factory)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, spans: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, and on wish hit_spans: code points of docs' text.

    Items of one id count once; their ids appear as text, sorted as text. Columns of
    docs that have one of these names give way, all others stay.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("binary").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / block_bytes))
    runs, names = fresh(docs, "runs_hit", "items_hit")
    scratch, out, block = Scratch(docs.sparkSession), docs, []
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).collect()
        for more in in_blocks(sorted((r["id"], bytes(r["text"])) for r in rows), block_bytes, window):
            if block:  # written, lest the workers of all blocks run at once
                out = scratch.keep(_scan(out, text, block, window, False, runs, names))
            block = more
    return _scan(out, text, block, window, spans, runs, names).drop(runs, names)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


#: Windows of every length that occurs, joined by their words; ASCII letters alone change case.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT row_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT row_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT row_id, dw.k, p, item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT row_id, count(DISTINCT q) AS n_hit FROM (SELECT row_id, unnest(generate_series(p, p + k - 1)) AS q FROM m) GROUP BY row_id),
n AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN n USING (row_id)
"""
