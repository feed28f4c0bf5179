"""Hard negatives: rows of another label that score a little under an anchor's own positives.

Components become floor(256 x); a score is the integer inner product with the anchor.
An anchor's positives are its best N_POSITIVES other rows of its label; for each of
them, the best N_NEGATIVES rows of another label whose score lies between LOW and HIGH
hundredths of the positive's are its negatives. Higher scores come first, ties by
smaller id.

Anchors are a stated query set. They go to all rows in blocks of at most BLOCK_BYTES,
one broadcast at a time, twice: once for positives, once for negatives in the windows
that the positives open. Each task holds scores for a tile of rows and a tile of
anchors, and passes on, for each anchor, only what could be among its best: that many
of the task's best by the same order. What is passed on is packed into keys (anchor,
descending score, positives first among equals, id) and dealt by anchor and sorted
inside partitions in one shuffle; an iterator over that order opens a window at each
positive and gives out negatives as they come, holding open windows and nothing else.

Rows with a null id, label or vector, or with a component that is null or not finite,
take no part. A shorter vector counts as having zeros at its end. Rows that agree in
id, side and score for an anchor count once; of several rows with an anchor's id, the
one of least label and vector is the anchor, and none of them is its positive or
negative. Scores past a signed 64-bit integer are held at its ends. A positive of score
0 has negatives of score 0, a negative one has none. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, table, tidy

FACTOR = 256
N_POSITIVES, N_NEGATIVES = 5, 10
#: Hundredths of a positive's score between which its negatives lie.
LOW, HIGH = 30, 90
#: Most bytes of the anchors' vectors that are broadcast at once, about.
BLOCK_BYTES = 8 << 20
TILE_ROWS, TILE_ANCHORS = 4096, 512
#: Integers of a smaller size are exact as doubles.
EXACT = 1 << 53
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("other", "u1"), ("id", ">u8")])
SIGN = np.uint64(1 << 63)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_components(flat: np.ndarray) -> np.ndarray:
    """floor(FACTOR x) as doubles where those are exact, else as Python's integers."""
    x = flat.astype(np.float64)
    if not len(x) or np.abs(x).max() < EXACT // FACTOR:
        return np.floor(x * FACTOR)
    return np.array([int(v) * FACTOR if abs(v) >= EXACT else math.floor(v * FACTOR) for v in x.tolist()], object)


def matrix(lists: pa.Array) -> np.ndarray:
    """Quantised vectors as rows, zeros after the shorter ones."""
    lists = lists.cast(pa.large_list(lists.type.value_type)) if pa.types.is_list(lists.type) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = whole_components(lists.flatten().to_numpy(zero_copy_only=False))
    wide = int(size.max()) if len(size) else 0
    if len(size) and (size == wide).all():
        return flat.reshape(len(size), wide)
    out = np.zeros((len(size), wide), flat.dtype)
    out[np.arange(wide) < size[:, None]] = flat
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where every sum is exact so, else integers held in 64 bits."""
    d = min(anchors.shape[1], rows.shape[1])
    a, r = anchors[:, :d], rows[:, :d]
    largest = lambda m: int(abs(m).max()) if m.size else 0
    if d * largest(a) * largest(r) < EXACT:
        return a.astype(np.float64) @ r.astype(np.float64).T
    exact = np.vectorize(int, otypes=[object])
    whole = exact(a) @ exact(r).T
    return np.clip(whole, LEAST, MOST).astype(np.int64)


@dataclass
class Block:
    """A block of anchors; windows [anchor, positive, 2] hold each positive's least and greatest score of a negative."""

    ids: np.ndarray
    labels: np.ndarray  # codes
    vectors: np.ndarray
    codes: dict[str, int]
    windows: np.ndarray | None = None


class Best:
    """The k best (score, id) of each of so many slots among all that were added; equal pairs count once."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full((slots, 1), LEAST)  # the k-th best score, where there are k

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score.astype(np.int64)], np.r_[self.id, ids]
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order around without overflow
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.r_[True, (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])][: len(slot)]
        slot, score, ids = slot[new], score[new], ids[new]
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
        place = np.arange(len(slot)) - np.repeat(begins, np.diff(np.r_[begins, len(slot)]))
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.floor[slot[last], 0] = score[last]

    def of_tile(self, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, repeated: bool) -> None:
        """Adds a tile's candidates: scores and fits are [slot, row]. Ties with the k-th best stay; repeated ids hide no other."""
        fits = fits & (scores >= self.floor)
        if not repeated and np.count_nonzero(fits) > 4 * self.k * len(fits):
            low = np.where(fits, scores, -np.inf if scores.dtype == np.float64 else LEAST)
            fits &= low >= np.partition(low, -self.k, axis=1)[:, -self.k, None]
        slot, row = np.nonzero(fits)
        if len(slot):
            self.add(slot, scores[slot, row], ids[row])


def packed(anchor: np.ndarray, score: np.ndarray, other: bool, ids: np.ndarray) -> pa.RecordBatch:
    """Rows (anchor, key) whose keys' bytes sort by anchor, descending score, positives first, id."""
    keys = np.zeros(len(anchor), KEY)
    keys["anchor"], keys["score"], keys["other"], keys["id"] = anchor.astype(np.uint64) ^ SIGN, ~(score.astype(np.uint64) ^ SIGN), other, ids.astype(np.uint64) ^ SIGN
    offsets = np.arange(0, (len(keys) + 1) * KEY.itemsize, KEY.itemsize, dtype=np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), binary], names=["anchor", "key"])


def unpacked(keys: pa.Array) -> list[tuple[int, int, int, int]]:
    """(anchor, score, other, id) of each key."""
    k = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    signed = lambda x: (x.astype(np.uint64) ^ SIGN).astype(np.int64).tolist()
    return list(zip(signed(k["anchor"]), signed(~k["score"].astype(np.uint64)), k["other"].tolist(), signed(k["id"]), strict=True))


def candidates(rows: DataFrame, block: Block, n_positives: int, n_negatives: int) -> DataFrame:
    """(anchor, key) of what each task's rows could add: positives where the block has no windows yet, else negatives."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        k, every = (n_positives, 1) if b.windows is None else (n_negatives, b.windows.shape[1])
        tiles = [slice(a, a + TILE_ANCHORS) for a in range(0, len(b.ids), TILE_ANCHORS)]
        found = [[Best(len(b.ids[t]), k) for _ in range(every)] for t in tiles]
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), matrix(batch.column(2))
            labels = np.array([b.codes.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for r in range(0, len(ids), TILE_ROWS):
                tile, own = ids[r : r + TILE_ROWS], labels[r : r + TILE_ROWS]
                repeated = len(np.unique(tile)) < len(tile)
                for t, best in zip(tiles, found, strict=True):
                    scores = products(b.vectors[t], vectors[r : r + TILE_ROWS])
                    same, itself = b.labels[t, None] == own, b.ids[t, None] == tile
                    if b.windows is None:
                        best[0].of_tile(scores, same & ~itself, tile, repeated)
                        continue
                    fits = ~(same | itself)
                    for w in range(every):
                        low, high = b.windows[t, w, :1], b.windows[t, w, 1:]
                        best[w].of_tile(scores, fits & (scores >= low) & (scores <= high), tile, repeated)
        for t, best in zip(tiles, found, strict=True):
            slot, score, ids = (np.concatenate([getattr(x, name) for x in best]) for name in ("slot", "score", "id"))
            once = np.unique(np.stack([slot, score, ids], axis=1), axis=0)  # windows overlap
            yield packed(b.ids[t][once[:, 0]], once[:, 1], b.windows is not None, once[:, 2])

    return rows.select("id", "label", "vector").mapInArrow(tidy(run), "anchor long, key binary")


def in_key_order(found: DataFrame) -> DataFrame:
    """Anchors dealt over partitions, each partition in the order of keys: the secondary sort."""
    return found.repartition("anchor").sortWithinPartitions("key")


def first_positives(found: DataFrame, n_positives: int) -> DataFrame:
    """(anchor, key, id, score) of each anchor's positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held, last = None, 0, None
        for batch in batches:
            out = []
            for key, at in zip(batch.column(1).to_pylist(), unpacked(batch.column(1)), strict=True):
                if at[0] != anchor:
                    anchor, held, last = at[0], 0, None
                if at != last and held < n_positives:
                    held, last = held + 1, at
                    out.append((at[0], key, at[3], at[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["anchor", "key", "id", "score"])

    return in_key_order(found).mapInArrow(tidy(run), "anchor long, key binary, id long, score long")


RESULT = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def negatives_in_windows(found: DataFrame, n_negatives: int, low: int, high: int) -> DataFrame:
    """The result, from positives and candidates of negatives in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, last, windows = None, None, []
        for batch in batches:
            out = []
            for at in unpacked(batch.column(1)):
                if at[0] != anchor:
                    anchor, windows = at[0], []
                if at == last:
                    continue
                last, (_, score, other, own) = at, at
                if not other:
                    windows.append([own, score, 0])  # positive, its score, negatives given out
                    continue
                for w in windows:
                    if low * w[1] <= 100 * score <= high * w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], own, w[1], score))
                # scores only fall: a full window, or one that lies above, takes no more
                windows = [w for w in windows if w[2] < n_negatives and low * w[1] <= 100 * score]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(RESULT)], schema=RESULT)

    return in_key_order(found).mapInArrow(tidy(run), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def usable(df: DataFrame, anchor: Column, id: str, label: str, vector: str) -> DataFrame:
    """id, label, vector and anchor of the rows that take part."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~odd)


def block_of(anchors: pa.Table) -> Block:
    labels = anchors.column("label").to_pylist()
    codes = {x: i for i, x in enumerate(sorted(set(labels)))}
    return Block(anchors.column("id").to_numpy(), np.array([codes[x] for x in labels], np.int64), matrix(anchors.column("vector").combine_chunks()), codes)


def windows_of(block: Block, positives: list, n_positives: int, low: int, high: int) -> np.ndarray:
    """Each positive's least and greatest score of a negative; an empty window where there is no such positive."""
    place, held = {x: i for i, x in enumerate(block.ids.tolist())}, [0] * len(block.ids)
    out = np.zeros((len(block.ids), n_positives, 2), np.int64)
    out[:, :, 0] = 1
    for r in positives:
        i = place[r["anchor"]]
        out[i, held[i]] = -(-low * r["score"] // 100), high * r["score"] // 100
        held[i] += 1
    return out


def mine(df: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores for the rows where anchor holds."""
    scratch = Scratch(df.sparkSession)
    rows = usable(df, anchor, id, label, vector)
    queries = rows.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"))
    queries = scratch.keep(queries.select("id", "x.label", "x.vector"))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("wide")).first()
    blocks = max(1, math.ceil(size["n"] * (size["wide"] or 0) * 8 / block_bytes))
    parts = []
    for i in range(blocks):
        # a block of bounded size at a time: the stated queries, never the rows they meet
        block = block_of(queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow())
        near = scratch.keep(candidates(rows, block, n_positives, n_negatives))
        first = scratch.keep(first_positives(near, n_positives))
        block.windows = windows_of(block, first.select("anchor", "score").collect(), n_positives, low, high)
        parts += [first.select("anchor", "key"), first, scratch.keep(candidates(rows, block, n_positives, n_negatives))]
        scratch.drop(near)
    found = parts[0].unionByName(parts[2])
    for i in range(3, len(parts), 3):
        found = found.unionByName(parts[i]).unionByName(parts[i + 2])
    out = cut(negatives_in_windows(found, n_negatives, low, high))
    scratch.drop(queries, *[p for i, p in enumerate(parts) if i % 3])
    return out


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("vec_id") % 100 == 0)


SQL = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({FACTOR} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {N_POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {N_NEGATIVES}"""
