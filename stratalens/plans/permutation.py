"""Within-stratum permutation tests.

Three engines. ``permuted`` numbers the units of every (draw, stratum) by a hash of
(seed, draw, unit) and gives the k-th the attribute of the stratum's k-th unit: SQL
throughout, the same in any engine, with every unit copied for each draw, so for small
tables; ``permuted_cells`` (in hashed.py) has the sums of the same draws by cell, for
large ones. ``grouped_cells`` permutes inside Arrow groups: a stratum's units are dealt
over the leaves of a binary tree of at most about CHUNK units each; every draw passes
the stratum's labels down that tree by hypergeometric splits addressed by (seed,
stratum, node), so a task walks the few nodes above its own leaf and knows no other
leaf. Units are shuffled once, and rows leaving a group don't grow with them.
``table_null`` draws the count tables themselves from their margins: the same null
distribution for statistics that see attributes through counts alone, whatever the
number of units.

Random streams depend on (seed, stratum, node or block), never on partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cell_statistics
from ..operators.ranks import in_hash_order, numbered
from ..operators.statistics import cells, observed
from .draws import stream, tables, walk
from .hashed import permuted_cells
from .shared import cut

#: A null draw counts as reaching the observed value within this, relative to it.
TOLERANCE = 1e-9
#: A two-sided draw reaches the observed gap within this.
TWO_SIDED_TOLERANCE = 1e-12
#: What the grouped engine tests unless told otherwise.
TESTED = ["conditional_g2", "mean_disparity", "regression_lrt"]
#: Draws that a task holds at once.
BLOCK = 250
#: Most units of a leaf, about.
CHUNK = 8192


def permuted(df: DataFrame, b: int, seed: int) -> DataFrame:
    """b rows for every unit (of a numeric, unique unit_id): draw (from 1) and the permuted attribute a; other columns as they are."""
    df = cut(df)
    fixed = numbered(df, "unit_id", "_k", ["z"])
    labels = fixed.select(F.col("z").alias("_z"), F.col("_k").alias("_own"), F.col("a").alias("_a"))
    draws = df.drop("a").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(b))))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "draw", F.col("unit_id").cast("string")), 256)
    shuffled = in_hash_order(draws.withColumn("_key", key), "_key", "_slot", ["draw", "z"], rows=df.count()).drop("_key")
    return shuffled.join(labels, (F.col("z") == F.col("_z")) & (F.col("_slot") == F.col("_own"))).withColumn("a", F.col("_a")).drop("_z", "_slot", "_own", "_a")


def p_values(null: DataFrame, real: DataFrame, b: int, two_sided: bool = False) -> DataFrame:
    """Rows (statistic, observed, n_at_least, p_value) of null (draw, statistic, value) and real (statistic, observed)."""
    if two_sided:
        hit = F.abs("value") >= F.abs("observed") - TWO_SIDED_TOLERANCE
    else:
        hit = F.col("value") >= F.col("observed") - TOLERANCE * F.greatest(F.lit(1.0), F.abs("observed"))
    out = null.join(F.broadcast(real), "statistic").groupBy("statistic", "observed").agg(F.count_if(hit).alias("n_at_least"))
    return out.withColumn("p_value", (1 + F.col("n_at_least")) / (b + 1))


def _cells_will_do(df: DataFrame, names: list[str]) -> bool:
    """Whether the draws of permuted may come as cells: for statistics of cells, where all scores are finite."""
    return set(names) <= set(cell_statistics.CELL_STATISTICS) and df.filter("s_raw IS NULL OR isnan(s_raw) OR abs(s_raw) = double('inf')").isEmpty()


def _centred(df: DataFrame) -> DataFrame:
    """df with scores about their overall mean."""
    centre = df.agg(F.avg("s_raw").alias("_m"))
    return df.crossJoin(F.broadcast(centre)).withColumn("s_raw", F.col("s_raw") - F.col("_m")).drop("_m")


def portable_test(df: DataFrame, names: list[str], b: int, seed: int) -> DataFrame:
    """p-values over the draws of permuted. Statistics of cells see their sums alone; others, and scores that aren't finite, take rows."""
    df = cut(df)
    if _cells_will_do(df, names):
        null = cell_statistics.long(permuted_cells(_centred(df), b, seed), names, ["draw"], "value")
    else:
        null = observed(cut(permuted(df, b, seed)), names, ["draw"]).withColumnRenamed("observed", "value")
    return p_values(null, observed(df, names), b)


def leaves(df: DataFrame, chunk: int, by: list[str] | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """df with depth and leaf, and a row a leaf with its path: the units under the left and right child of each node above it, from the root down.

    A group of n rows has 2^depth leaves of about chunk rows or fewer, dealt by a hash of
    unit_id. Paths hold as many entries as a leaf is deep; no list of leaves is made.
    With a weight, a leaf's size is its rows' total of it.
    """
    keys = by or ["z"]
    size = F.sum(weight) if weight else F.count("*")
    groups = df.groupBy(*keys).agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / chunk))).cast("int").alias("depth"))
    placed = df.join(groups, keys).withColumn("leaf", F.pmod(F.xxhash64("unit_id"), F.pow(F.lit(2.0), "depth").cast("long")))
    sizes = placed.groupBy(*keys, "depth", "leaf").agg(size.cast("long").alias("k"))
    steps = sizes.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    steps = steps.filter("level < depth").withColumns({"node": F.expr("shiftright(leaf, depth - level)"), "right": F.expr("shiftright(leaf, depth - level - 1) & 1") == 1})
    nodes = steps.groupBy(*keys, "level", "node").agg(F.sum(F.when(~F.col("right"), F.col("k")).otherwise(0)).alias("l"), F.sum(F.when(F.col("right"), F.col("k")).otherwise(0)).alias("r"))
    path = steps.join(nodes, [*keys, "level", "node"]).groupBy(*keys, "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "l", "r"))).alias("path"))
    return placed.drop("depth"), sizes.select(*keys, "leaf").join(path, [*keys, "leaf"], "left")


def path_of(row) -> list[tuple[int, int]]:
    return [(int(x["l"]), int(x["r"])) for x in row] if row is not None else []


def grouped_cells(df: DataFrame, b: int, seed: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(draw, z, s_bin, a, n, s_sum, s_sq) of draws 0 (the data) to b: every draw a uniform permutation of each whole stratum."""
    df = df.select("unit_id", "s_raw", "s_bin", "a", "z")
    placed, paths = leaves(df, chunk)
    labels = df.groupBy("z", "a").agg(F.count("*").alias("k")).groupBy("z").agg(F.array_sort(F.collect_list(F.struct("a", "k"))).alias("labels"))
    known = paths.join(labels, "z").select(F.col("z").alias("of"), F.col("leaf").alias("at"), "path", "labels")

    def work(units: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values("unit_id", kind="stable")
        z, leaf = units["z"].iloc[0], int(units["leaf"].iloc[0])
        own = units["a"].to_numpy(np.int64)
        bins, code = np.unique(units["s_bin"].to_numpy(np.int64), return_inverse=True)
        s = units["s_raw"].to_numpy(float)
        names = np.array([x["a"] for x in above["labels"].iloc[0]], np.int64)
        whole, path, k = [int(x["k"]) for x in above["labels"].iloc[0]], path_of(above["path"].iloc[0]), len(names)
        size = len(bins) * k
        out = []
        for first in range(0, b + 1, block):
            draws = np.arange(first, min(first + block, b + 1))
            mine = walk(seed, (z, first), path, leaf, np.tile(np.array(whole, np.int64), (len(draws), 1)))
            rng = stream(seed, z, first, "leaf", leaf)
            # each draw's labels of this leaf in random order
            order = np.repeat(np.tile(np.arange(k), len(draws)), mine.ravel()).reshape(len(draws), len(own))
            a = rng.permuted(order, axis=1)
            if first == 0:
                a[0] = np.searchsorted(names, own)
            at = (np.arange(len(draws))[:, None] * size + code * k + a).ravel()
            n, total, squares = (np.bincount(at, w, len(draws) * size) for w in (None, np.tile(s, len(draws)), np.tile(s * s, len(draws))))
            there = np.flatnonzero(n)
            cell = there % size
            out.append(pd.DataFrame({"draw": draws[there // size].astype(np.int32), "z": z, "s_bin": bins[cell // k].astype(np.int32), "a": names[cell % k].astype(np.int32), "n": n[there], "s_sum": total[there], "s_sq": squares[there]}))
        return pd.concat(out)

    kind = df.schema["z"].dataType.simpleString()
    parts = placed.groupBy("z", "leaf").cogroup(known.groupBy("of", "at")).applyInPandas(work, f"draw int, z {kind}, s_bin int, a int, n long, s_sum double, s_sq double")
    return parts.groupBy("draw", "z", "s_bin", "a").agg(*[F.sum(c).alias(c) for c in cell_statistics.SUMS])


def grouped_null(df: DataFrame, b: int, seed: int, block: int = BLOCK, chunk: int = CHUNK, names: list[str] | None = None) -> DataFrame:
    """(draw, statistic, value) of draws 0 (the data) to b for any statistics of cells, all from the same draws.

    Scores are taken about their overall mean, so statistics must not change when all
    scores move alike.
    """
    df = _centred(cut(df))
    return cell_statistics.long(grouped_cells(df, b, seed, block, chunk), names or TESTED, ["draw"], "value")


def grouped_test(df: DataFrame, b: int, seed: int, names: list[str] | None = None, two_sided: bool = False) -> DataFrame:
    """p-values of statistics of cells (TESTED unless named, registered ones too) over b draws."""
    null = cut(grouped_null(df, b, seed, names=names))
    real = null.filter("draw = 0").select("statistic", F.col("value").alias("observed"))
    return p_values(null.filter("draw > 0"), real, b, two_sided)


def table_null(df: DataFrame, b: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(draw, value) of conditional_g2 from count tables drawn with the data's margins; draw 0 is the data."""
    return cells_null(cells(df), b, seed, block=block)


def cells_null(cube: DataFrame, b: int, seed: int, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """table_null from cells (by, z, s_bin, a, n): (by, draw, value). Counts may be any to 10^15.

    Groups hold a stratum's cells, not its units, so a large stratum is a small task.
    """
    keys = by or []
    blocks = cube.select(*keys, "z", "s_bin", "a", "n", F.explode(F.sequence(F.lit(0), F.lit(b), F.lit(block))).alias("first"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["first"].iloc[0])
        names = [pdf[c].iloc[0] for c in keys]
        rows, cols = np.unique(pdf["s_bin"], return_inverse=True)[1], np.unique(pdf["a"], return_inverse=True)[1]
        real = np.zeros((rows.max() + 1, cols.max() + 1), np.int64)
        np.add.at(real, (rows, cols), pdf["n"].to_numpy(np.int64))
        n_s, n_a = real.sum(1), real.sum(0)
        draws = np.arange(first, min(first + block, b + 1))
        t = tables(stream(seed, *names, pdf["z"].iloc[0], first, "table"), n_s, np.tile(n_a, (len(draws), 1))).astype(float)
        if first == 0:
            t[0] = real
        expected = np.outer(n_s.astype(float), n_a) / n_s.sum()
        g2 = 2 * np.where(t > 0, t * np.log(np.where(t > 0, t, 1) / expected), 0).sum((1, 2))
        return pd.DataFrame({**{c: x for c, x in zip(keys, names, strict=True)}, "draw": draws.astype(np.int32), "value": g2})

    kinds = "".join(f"{c} {cube.schema[c].dataType.simpleString()}, " for c in keys)
    return blocks.groupBy(*keys, "z", "first").applyInPandas(work, f"{kinds}draw int, value double").groupBy(*keys, "draw").agg(F.sum("value").alias("value"))


def paired_test(df: DataFrame, b: int, seed: int) -> DataFrame:
    """Two-sided test of the weighted gap of paired differences (s_raw), with an absolute tolerance of 1e-12."""
    from ..operators.gaps import mean_gap

    df = cut(df)
    real = mean_gap(df).select(F.col("gap").alias("observed"))
    if _cells_will_do(df, ["weighted_gap"]):
        null = cell_statistics.wide(permuted_cells(df.withColumn("s_bin", F.lit(0)), b, seed), ["weighted_gap"], ["draw"]).withColumnRenamed("weighted_gap", "gap")
    else:
        null = mean_gap(permuted(df, b, seed), by=["draw"])
    hits = null.crossJoin(F.broadcast(real)).agg(F.count_if(F.abs("gap") >= F.abs("observed") - TWO_SIDED_TOLERANCE).alias("n_at_least"))
    return real.crossJoin(hits).withColumn("p_value", (1 + F.col("n_at_least")) / (b + 1))


def grouped_paired_test(df: DataFrame, b: int, seed: int) -> DataFrame:
    """paired_test by the grouped engine: units are shuffled once, whatever b and the size of a stratum."""
    one_bin = df.select("unit_id", "s_raw", F.lit(0).alias("s_bin"), "a", "z")
    return grouped_test(one_bin, b, seed, ["weighted_gap"], two_sided=True).drop("statistic")
