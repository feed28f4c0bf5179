"""Prefix-filter set-similarity joins: postings, hubs, candidates, and connected classes.

A set's keys are in one global order (see :mod:`.tokens`), rarest first. Two sets of
sizes a and b are similar where NUM/DEN of their union is shared, that is where
they share at least ``t = ceil(NUM (a + b) / (NUM + DEN))`` keys; then for every l
up to t they share l keys among the first ``a - t + l`` and ``b - t + l``.

Groups of one key are never turned into all their pairs. First every member is
compared with one member, the group's hub; what that settles leaves the rest to be
joined with the group: the cost is in proportion to the group for every member
that its hub doesn't settle. Keys of a great many sets are split over salts, each
with a hub of its own, and those hubs are compared with the key's first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Two sets are similar from 80 hundredths of their union.
NUM, DEN = 80, 100
#: Most sets of one key in one task's group, about.
HEAVY = 20_000
#: Up to so many documents (ids and hashes, about 30 bytes each) are sent to all executors; beyond, the join shuffles.
BROADCAST_DOCS = 400_000


def required(a: Column, b: Column) -> Column:
    return F.floor((NUM * (a + b) + (NUM + DEN - 1)) / (NUM + DEN)).cast("int")


def prefix_length(n: int, extra: int = 0) -> int:
    """Keys of a set of n that a partner of any size can need, for 1 + extra shared keys."""
    return min(n, n - -(-NUM * n // DEN) + 1 + extra)


def postings(sets: DataFrame, floor: float, heavy: int = HEAVY) -> DataFrame:
    """A row for each key of a set's prefix, of keys that other sets have too.

    sets: node (long), n, l (int) and prefix (array<long>, in key order). Gives
    token, pos, node, n, l, salts (over 1 for a split key), salt, and size: the rows
    of the key and salt.
    """
    # a set this small is out of reach for any of another size: n / (n + 1) is under the threshold
    rows = sets.filter(F.col("n") * DEN >= (F.col("n") + 1) * NUM).select("node", "n", "l", F.posexplode("prefix").alias("pos", "token"))
    level = F.shiftrightunsigned("token", 56)
    seen = F.pow(F.lit(2.0), level / 8) - 1 - 1.2 * floor
    rows = rows.withColumn("salts", F.greatest(F.lit(1), F.ceil(seen / heavy)).cast("int"))
    rows = rows.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("node"), F.col("salts"))).otherwise(0).cast("int"))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("token", "salt")))
    return rows.filter("size > 1 OR salts > 1")


def with_hubs(shared: DataFrame) -> DataFrame:
    """shared with hub, the node of each key and salt that shares most keys with others.

    Of documents copied from one another with changes, the one that the others
    were made from shares most, and is similar to most.
    """
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = shared.join(weights, "node")
    hubs = weighted.groupBy("token", "salt").agg(F.max(F.struct("weight", "node", "n", "l", "pos")).alias("hub"))
    return weighted.join(hubs, ["token", "salt"])


def compatible(a, b) -> Column:
    """Length and positional filters of two rows with one key; a and b give their columns."""
    t = required(a("n"), b("n"))
    l = F.least(a("l"), b("l"))  # noqa: E741
    return (F.least(a("n"), b("n")) * DEN >= F.greatest(a("n"), b("n")) * NUM) & (a("pos") < a("n") - t + l) & (b("pos") < b("n") - t + l)


def stars(shared: DataFrame) -> DataFrame:
    """node, hub and shares (of keys) of the pairs of a member and its group's hub, and of a salted key's hubs and their first."""
    own, hub = (lambda c: F.col(c)), (lambda c: F.col(f"hub.{c}"))
    with_hub = with_hubs(shared)
    direct = with_hub.filter((F.col("node") != F.col("hub.node")) & compatible(own, hub)).select("node", F.col("hub.node").alias("hub"))
    heads = with_hub.filter((F.col("salts") > 1) & (F.col("node") == F.col("hub.node"))).select("token", "hub")
    tops = heads.groupBy("token").agg(F.max("hub").alias("top"))
    upper = heads.join(tops, "token").filter(F.col("hub.node") != F.col("top.node")).select(F.col("hub.node").alias("node"), F.col("top.node").alias("hub"))
    return direct.unionByName(upper).groupBy("node", "hub").agg(F.count("*").alias("shares"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) of nodes whose whole sets (node, keys) are similar, by counting what they share."""
    a = sets.select(F.col("node").alias("x"), F.col("keys").alias("xs"))
    b = sets.select(F.col("node").alias("y"), F.col("keys").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    return pairs.join(a, "x").join(b, "y").filter(DEN * both >= NUM * (F.size("xs") + F.size("ys") - both)).select("x", "y").distinct()


def folded(sign: str, words: Column) -> Column:
    """A signature (array column, see :func:`signature`) of at most so many words, halves put together as often as it takes."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(sign) / words).cast("int") - 1), lambda k: F.slice(F.col(sign), k * words + 1, words))
    whole = F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), words), lambda total, part: F.zip_with(total, part, lambda p, q: p.bitwiseXOR(q)))
    return F.when(F.size(sign) > words, whole).otherwise(F.col(sign))


def differing(xs: str, ys: str) -> Column:
    """How many bits of two signatures differ; the longer is folded to the other's length."""
    bits = F.zip_with(folded(xs, F.size(ys)), folded(ys, F.size(xs)), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, k: total + k)


def room(a: Column, b: Column) -> Column:
    """How many keys may differ between similar sets of sizes a and b. Parities that differ are at most as many."""
    return a + b - 2 * required(a, b)


def perhaps_similar(pairs: DataFrame, signed: DataFrame, earlier: str | None = None) -> DataFrame:
    """The pairs (x, y) whose signatures (node, n, sign) leave room for a link, with d, the bits that differ.

    With earlier, a column of signed, only those whose x comes first by it.
    """
    order = F.col(earlier) if earlier else F.lit(None)
    a = signed.select(F.col("node").alias("x"), F.col("n").alias("xn"), F.col("sign").alias("xs"), order.alias("xo"))
    b = signed.select(F.col("node").alias("y"), F.col("n").alias("yn"), F.col("sign").alias("ys"), order.alias("yo"))
    joined = pairs.join(a, "x").join(b, "y").filter("xo < yo" if earlier else "true").withColumn("d", differing("xs", "ys"))
    return joined.filter(F.col("d") <= room(F.col("xn"), F.col("yn"))).select("x", "y", "d")


def signature(keys: np.ndarray) -> np.ndarray:
    """Parities of keys by hash, four to eight for each key, as signed words of 64; lengths are powers of two."""
    size = max(64, 4 << (len(keys) - 1).bit_length())
    bits = np.bincount((keys & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (the class' least node) of every node of edges (x, y), as a table of scratch.

    Rounds of taking the least label among neighbours and then that label's own
    label; each is written to the shared folder, and the last changes nothing.
    """
    both = scratch.keep(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v"))))
    labels = scratch.keep(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("least"))
        hooked = labels.select("node", "comp").join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        above = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = scratch.keep(hooked.join(above, "comp", "left").select("node", "old", F.least("comp", "up").alias("comp")))
        scratch.drop(labels)
        if new.filter("comp <> old").isEmpty():
            scratch.drop(both)
            return new
        labels = new
