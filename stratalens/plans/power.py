"""Power planning: samples from a pool with a shift put in, tested many times.

A pool goes to the tasks as counts of its distinct (stratum, score, group) triples,
whatever its units; cells (size, share shifted, replicate) are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .experiment import Draws
from ..operators.ranks import counted
from .draws import stream
from .permutation import TOLERANCE


def pool_of(df: DataFrame) -> DataFrame:
    """z, s, a of the units of informative strata, by counts: distinct triples and how many there are."""
    from ..operators.strata import in_informative

    return in_informative(df).groupBy("z", F.col("s_raw").alias("s"), "a").agg(F.count("*").alias("n"))


def power(df: DataFrame, sizes: list[int], shares: list[float], replicates: int, permutations: int, seed: int, low: float = 1, high: float = 6, alpha: float = 0.05) -> DataFrame:
    """size, share, power, mean_usable_strata and mean_n_a1 of the conditional G2 test.

    Each replicate draws size units, adds -1, 0 or 1 to the score at random, and
    takes one off the score of a share of group 1; scores stay in [low, high].
    """
    pdf = pool_of(df).orderBy("z", "s", "a").toPandas()  # a row a triple
    columns = np.unique(pdf["z"], return_inverse=True)[1], pdf["s"].to_numpy(float), pdf["a"].to_numpy(int), np.cumsum(pdf["n"].to_numpy(np.int64))
    shared = df.sparkSession.sparkContext.broadcast(columns)
    tasks = df.sparkSession.createDataFrame([(n, p) for n in sizes for p in shares], "size int, share double").crossJoin(df.sparkSession.range(replicates).withColumnRenamed("id", "replicate"))

    def work(batches):
        zs, ys, groups_of, ends = shared.value
        units = int(ends[-1]) if len(ends) else 0
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                rng = stream(seed, t.size, t.share, t.replicate, "power")
                # units by number; a number's triple is that whose end is the first above it
                own = np.searchsorted(ends, rng.choice(units, min(int(t.size), units), replace=False, shuffle=False), side="right")
                z, y, a = zs[own], ys[own], groups_of[own]
                s = y + rng.integers(-1, 2, len(own)) - ((rng.random(len(own)) < t.share) & (a == 1))
                draws = Draws(s, np.unique(np.clip(s, low, high), return_inverse=True)[1], z)
                labels = a[draws.order]
                null = draws.statistics(draws.permute(labels, permutations, rng))[0]
                real = draws.statistics(labels[None].astype(np.int8))[0][0]
                p = (1 + (null >= real - TOLERANCE * max(1.0, abs(real))).sum()) / (permutations + 1)
                groups = np.split(labels, draws.starts[1:])
                out.append((t.size, t.share, int(p <= alpha), sum(len(g) > 1 and g.min() != g.max() for g in groups), int(labels.sum())))
            yield pd.DataFrame(out, columns=["size", "share", "reject", "usable", "n_a1"])

    rows = tasks.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(work, "size int, share double, reject int, usable int, n_a1 int")
    return rows.groupBy("size", "share").agg(F.avg("reject").alias("power"), F.avg("usable").alias("mean_usable_strata"), F.avg("n_a1").alias("mean_n_a1"), F.count("*").alias("replicates"))


def kolmogorov(p_values: DataFrame, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """The greatest distance of the p-values' distribution from the uniform, for each of by; ranks come from counted values."""
    keys = by or []
    placed = counted(p_values, p, keys)
    n = placed.groupBy(*keys).agg(F.sum("_k").alias("tests"))
    placed = placed.join(n, keys) if keys else placed.crossJoin(F.broadcast(n))
    gap = F.greatest((F.col("_below") + F.col("_k")) / F.col("tests") - F.col("_value"), F.col("_value") - F.col("_below") / F.col("tests"))
    return placed.groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("tests").alias("tests"))
