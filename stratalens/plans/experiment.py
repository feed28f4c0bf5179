"""Rejection-rate experiments: a task table of (scenario, n, replicate), one row of work each.

Replicates are independent and small, so each is generated and tested inside one
Arrow batch row; Spark spreads the task table, and rates are one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.multiplicity import rejection_rates
from .draws import stream
from .permutation import TOLERANCE
from .scenarios import SCENARIOS, scenario

SCHEMA = "scenario string, n int, replicate int, method string, calibration string, p_value double, observed double, n_strata int, n_usable_strata int, n_score_bins int"


@dataclass(frozen=True)
class Config:
    scenarios: tuple[str, ...] = tuple(SCENARIOS)
    sizes: tuple[int, ...] = (200, 500, 2000)
    replicates: int = 1000
    permutations: int = 999
    bins: int = 8
    seed: int = 424243


def _bins(s: np.ndarray, k: int) -> np.ndarray:
    edges = np.unique(np.quantile(s, np.arange(1, k) / k))
    return np.unique(np.searchsorted(edges, s, side="right"), return_inverse=True)[1]


class Draws:
    """All statistics of many permutations at once: labels as a matrix of permutations by units."""

    def __init__(self, s: np.ndarray, bins: np.ndarray, z: np.ndarray):
        self.order = np.argsort(z, kind="stable")
        _, starts, counts = np.unique(z[self.order], return_index=True, return_counts=True)
        self.starts, self.counts, self.n = starts, counts, len(s)
        self.s, self.bins = s[self.order] - s.mean(), bins[self.order]

    def permute(self, a: np.ndarray, b: int, rng: np.random.Generator) -> np.ndarray:
        out = np.empty((b, self.n), np.int8)
        for i, k in zip(self.starts, self.counts, strict=True):
            block = np.tile(a[i : i + k], (b, 1)).astype(np.int8)
            out[:, i : i + k] = rng.permuted(block, axis=1)
        return out

    def statistics(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """G2, mean disparity and regression LRT for each row of binary labels."""
        g2, disparity, rss1 = np.zeros(len(labels)), np.zeros(len(labels)), np.zeros(len(labels))
        rss0 = 0.0
        for i, k in zip(self.starts, self.counts, strict=True):
            own, s, bins = labels[:, i : i + k].astype(float), self.s[i : i + k], self.bins[i : i + k]
            hot = np.eye(bins.max() + 1)[bins]
            n_s, n1 = hot.sum(0), own.sum(1)
            c1 = own @ hot
            xlogx = lambda x: np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0.0)
            g2 += 2 * (xlogx(c1).sum(1) + xlogx(n_s - c1).sum(1) + xlogx(np.array(float(k))) - xlogx(n_s).sum() - xlogx(n1) - xlogx(k - n1))
            s1, total = own @ s, s.sum()
            both = (n1 > 0) & (n1 < k)
            m1, m0 = s1 / np.maximum(n1, 1), (total - s1) / np.maximum(k - n1, 1)
            disparity += np.where(both, k / self.n * np.abs(m1 - m0), 0.0)
            rss1 += (s * s).sum() - np.where(n1 > 0, s1 * m1, 0.0) - np.where(n1 < k, (total - s1) * m0, 0.0)
            rss0 += (s * s).sum() - total * total / k
        return g2, disparity, self.n * np.log(max(rss0, 1e-300) / np.maximum(rss1, 1e-300))


def replicate(config: Config, name: str, n: int, number: int) -> list[tuple]:
    s, a, z = scenario(name).draw(n, stream(config.seed, name, n, number, "data"))
    bins = _bins(s, config.bins)
    draws = Draws(s, bins, z)
    own = a[draws.order]
    labels = draws.permute(own, config.permutations, stream(config.seed, name, n, number, "permutation"))
    real, null = draws.statistics(own[None].astype(np.int8)), draws.statistics(labels)
    strata = np.split(own, draws.starts[1:])
    usable = sum(len(g) >= 2 and g.min() != g.max() for g in strata)
    rest = (len(strata), usable, int(bins.max()) + 1)
    out = []
    for method, r, t in zip(("conditional_g2", "mean_disparity", "regression_lrt"), real, null, strict=True):
        hits = int((t >= r[0] - TOLERANCE * max(1.0, abs(r[0]))).sum())
        out.append((name, n, number, method, "permutation", (1 + hits) / (config.permutations + 1), float(r[0]), *rest))
    return out


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Long rows of every replicate's p-values."""
    tasks = None
    for name in config.scenarios:
        for n in config.sizes:
            part = spark.range(config.replicates).select(F.lit(name).alias("scenario"), F.lit(n).alias("n"), F.col("id").cast("int").alias("replicate"))
            tasks = part if tasks is None else tasks.unionByName(part)
    many = max(spark.sparkContext.defaultParallelism, config.replicates * len(config.scenarios) * len(config.sizes) // 25)

    def work(batches):
        for pdf in batches:
            rows = [r for t in pdf.itertuples(index=False) for r in replicate(config, t.scenario, int(t.n), int(t.replicate))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return tasks.repartition(many).mapInPandas(work, SCHEMA)


def rates(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    nulls = F.create_map(*[F.lit(x) for s in SCENARIOS.values() for x in (s.name, s.null)])
    out = rejection_rates(rows, ["scenario", "n", "method", "calibration"], "p_value", alpha)
    return out.withColumn("null_status", nulls[F.col("scenario")])
