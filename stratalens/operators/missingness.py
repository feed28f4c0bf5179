"""Audits of excluded units: rates, tables for exact tests, length differences, position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles, with_below


def exclusion_rates(df: DataFrame, by: str = "a", excluded: str = "excluded") -> DataFrame:
    """n, excluded, rate and its standard error for each group."""
    p = F.col("k") / F.col("n")
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(excluded).alias("k"))
    return out.withColumns({"rate": F.bround(p, 5), "se": F.bround(F.sqrt(p * (1 - p) / F.col("n")), 5)})


def two_by_two(df: DataFrame, a: str = "a", excluded: str = "excluded") -> DataFrame:
    """One row: excluded and kept of group 1, excluded and kept of group 0."""
    count = lambda g, x: F.count_if((F.col(a) == g) & (F.col(excluded) == x))
    return df.agg(count(1, True).alias("a1_excluded"), count(1, False).alias("a1_kept"), count(0, True).alias("a0_excluded"), count(0, False).alias("a0_kept"))


def homogeneity(df: DataFrame, z: list[str], excluded: str = "excluded", least: int = 30) -> DataFrame:
    """Chi-square of exclusion over strata of at least so many units, and its degrees of freedom."""
    strata = df.groupBy(*z).agg(F.count("*").alias("n"), F.count_if(excluded).alias("k")).filter(F.col("n") >= least)
    whole = strata.agg((F.sum("k") / F.sum("n")).alias("rate"))
    e = F.col("n") * F.col("rate")
    f = F.col("n") * (1 - F.col("rate"))
    term = F.try_divide((F.col("k") - e) ** 2, e) + F.try_divide((F.col("k") - e) ** 2, f)
    return strata.crossJoin(F.broadcast(whole)).agg(F.sum(term).alias("chi2"), (F.count("*") - 1).alias("df"), F.count("*").alias("strata"))


def group_difference(df: DataFrame, value: str, group: str) -> DataFrame:
    """Means, medians, standardised difference and Mann-Whitney U of a value between a boolean group and the rest.

    U and the medians come from counts of distinct values: no window over all units, no task that holds them.
    """
    one = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    base = df.agg(
        F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n0"), one(F.avg, True).alias("mean1"), one(F.avg, False).alias("mean0"),
        one(F.var_samp, True).alias("_v1"), one(F.var_samp, False).alias("_v0"),
    )
    values = df.groupBy(value).agg(F.count_if(F.col(group)).alias("k1"), F.count("*").alias("k"))
    ranks = with_below(values, value, "k", "below").select("k1", "k", (F.col("below") + (F.col("k") + 1) / 2).alias("rank")).agg(F.sum(F.col("k1") * F.col("rank")).alias("r1"), F.sum(F.col("k").cast("double") ** 3 - F.col("k")).alias("tie_sum"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("_v1") + (F.col("n0") - 1) * F.col("_v0")) / (F.col("n1") + F.col("n0") - 2))
    middle = quantiles(df, value, [0.5], "_m", [group])
    medians = middle.agg(*[F.max(F.when(F.col(group) == g, F.col("_m")[0])).alias(f"median{int(g)}") for g in (True, False)])
    out = base.crossJoin(ranks).crossJoin(medians)
    return out.select("n1", "n0", "mean1", "mean0", "median1", "median0", pooled.alias("pooled_sd"), F.try_divide(F.col("mean1") - F.col("mean0"), pooled).alias("smd"), (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "tie_sum")


def position_deciles(df: DataFrame, position: str, n: str) -> DataFrame:
    """df with decile d where position is in [floor(n d / 10), floor(n (d + 1) / 10))."""
    starts = F.array(*[F.floor(F.col(n) * d / 10) for d in range(1, 10)])
    return df.withColumn("decile", F.size(F.filter(starts, lambda s: s <= F.col(position))))


def time_tenths(df: DataFrame, t: str) -> DataFrame:
    """df with tenth: right-open between quantiles of t, the last closed. The quantiles are one broadcast row."""
    edges = quantiles(df, t, [k / 10 for k in range(1, 10)], "_edges")
    return df.crossJoin(F.broadcast(edges)).withColumn("tenth", F.size(F.filter("_edges", lambda e: e <= F.col(t)))).drop("_edges")
