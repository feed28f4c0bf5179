"""Bootstrap intervals.

Two engines. ``stratified_bootstrap`` and ``cluster_bootstrap`` take hashed draws, the
same in any engine and partitioning: a hash and two bytes for every unit (or cluster)
and resample. ``count_bootstrap`` and ``count_cluster_bootstrap`` draw
how often each distinct cell is taken: a group's units fall over the leaves of a binary
tree by binomial splits addressed by (seed, group, node), and over a leaf's cells by one
multinomial draw, so nothing is copied for each resample and what leaves a task is its
totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gaps import mean_gap
from ..operators.ranks import numbered, with_below
from .draws import resample, stream
from .hashed import drawn_sums
from .permutation import BLOCK, CHUNK, leaves, path_of


def interval(reps: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return reps.groupBy(*(by or [])).agg(F.percentile(value, F.lit(tail)).alias("ci_low"), F.percentile(value, F.lit(1 - tail)).alias("ci_high"), F.count("*").alias("reps"))


def stratified_bootstrap(df: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, gap) of resamples with strata's sizes fixed; strata that lose a group drop out of that resample.

    Slot j of a stratum in resample r takes the unit whose number is a hash of
    (seed, r, stratum, j), so only numbers meet.
    """
    places = numbered(df.filter("z IS NOT NULL"), "unit_id", "_k", ["z"]).select("z", "a", "s_raw", (F.col("_k") - 1).alias("k"))
    seen = F.col("s_raw").isNotNull()
    own = {f"{c}{g}": F.when((F.col("a") == g) & seen, x).otherwise(0.0) for g in (0, 1) for c, x in (("n", F.lit(1.0)), ("s", F.col("s_raw")))}
    drawn = drawn_sums(places.select("z", "k", F.lit(1.0).alias("n"), *[x.alias(c) for c, x in own.items()]), ["n", *own], reps, seed)
    strata = drawn.withColumn("d", F.try_divide("s1", "n1") - F.try_divide("s0", "n0"))
    return strata.filter("d IS NOT NULL").groupBy("rep").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("gap"))


def cluster_bootstrap(clusters: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, mean) of resampled clusters; clusters has cluster (numeric), d_sum and n: whole clusters are drawn, by multiplicity.

    Only cluster totals take part, whatever the number of units.
    """
    one = clusters.withColumn("_one", F.lit(1).cast("long"))
    places = with_below(one, "cluster", "_one", "k").select(F.lit(0).alias("z"), "k", F.coalesce(F.col("d_sum").cast("double"), F.lit(0.0)).alias("d_sum"), F.col("n").cast("double").alias("n"))
    return drawn_sums(places, ["d_sum", "n"], reps, seed, named=False).select("rep", (F.col("d_sum") / F.col("n")).alias("mean"))


def resampled_totals(cells: DataFrame, reps: int, seed: int, sums: list[str], kind: str = "a", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(rep, z, kind, n, sums) of resamples of each z's units with replacement, its size kept.

    cells holds z, kind, k (units of the cell) and, for one unit of it, sums; unit_id is
    any hash of the cell.
    """
    placed, paths = leaves(cells, chunk, weight="k")
    sizes = cells.groupBy("z").agg(F.sum("k").alias("size"))
    known = paths.join(sizes, "z").select(F.col("z").alias("of"), F.col("leaf").alias("at"), "path", "size")

    def work(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["unit_id", kind, *sums], kind="stable")
        z, leaf, weight = own["z"].iloc[0], int(own["leaf"].iloc[0]), own["k"].to_numpy(float)
        mine = resample(seed, (z,), path_of(above["path"].iloc[0]), leaf, int(above["size"].iloc[0]), reps)
        rng = stream(seed, z, "leaf", leaf)
        kinds, of = np.unique(own[kind], return_inverse=True)
        totals = np.zeros((reps, len(kinds), 1 + len(sums)))
        values = np.column_stack([np.ones(len(own)), *[own[c].to_numpy(float) for c in sums]])
        for first in range(0, reps, block):
            drawn = rng.multinomial(mine[first : first + block], weight / weight.sum())
            for i in range(len(kinds)):
                totals[first : first + block, i] = drawn[:, of == i] @ values[of == i]
        rep = np.repeat(np.arange(1, reps + 1, dtype=np.int32), len(kinds))
        flat = totals.reshape(-1, 1 + len(sums))
        return pd.DataFrame({"rep": rep, "z": z, kind: np.tile(kinds, reps), "n": flat[:, 0].astype(np.int64), **{c: flat[:, 1 + i] for i, c in enumerate(sums)}})

    types = dict(cells.dtypes)
    schema = f"rep int, z {types['z']}, {kind} {types[kind]}, n long, " + ", ".join(f"{c} double" for c in sums)
    parts = placed.groupBy("z", "leaf").cogroup(known.groupBy("of", "at")).applyInPandas(work, schema)
    return parts.groupBy("rep", "z", kind).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


def count_bootstrap(df: DataFrame, reps: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(rep, gap) as stratified_bootstrap has it, from counts of the distinct (z, a, s_raw)."""
    cells = df.groupBy("z", "a", "s_raw").agg(F.count("*").alias("k")).withColumn("unit_id", F.xxhash64("a", "s_raw"))
    totals = resampled_totals(cells, reps, seed, ["s_raw"], chunk=chunk)
    one = lambda g, c: F.sum(F.when(F.col("a") == g, F.col(c)))
    mean = lambda g: F.try_divide(one(g, "s_raw"), one(g, "n"))
    strata = totals.groupBy("rep", "z").agg(F.sum("n").alias("n"), (mean(1) - mean(0)).alias("d"))
    return strata.filter("d IS NOT NULL").groupBy("rep").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("gap"))


def count_cluster_bootstrap(clusters: DataFrame, reps: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(rep, mean) as cluster_bootstrap has it, from counts of the distinct (d_sum, n)."""
    cells = clusters.groupBy("d_sum", F.col("n").alias("units")).agg(F.count("*").alias("k"))
    cells = cells.select(F.lit(0).alias("z"), F.lit(0).alias("a"), "d_sum", F.col("units").cast("double").alias("units"), "k", F.xxhash64("d_sum", "units").alias("unit_id"))
    totals = resampled_totals(cells, reps, seed, ["d_sum", "units"], chunk=chunk)
    return totals.select("rep", (F.col("d_sum") / F.col("units")).alias("mean"))


def paired_interval(df: DataFrame, reps: int, seed: str) -> DataFrame:
    """The weighted gap of paired differences with its bootstrap interval."""
    return mean_gap(df).select(F.col("gap").alias("observed")).crossJoin(interval(stratified_bootstrap(df, reps, seed), "gap"))
