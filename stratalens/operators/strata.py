"""Strata: support, feasibility, and which of them are informative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stratum_table(df: DataFrame, z: list[str] | None = None) -> DataFrame:
    """n, n_a1, distinct attributes and the informative flag of every stratum."""
    keys = z or ["z"]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("a") == 1).cast("long")).alias("n_a1"), F.count_distinct("a").alias("n_a"))
    return out.withColumn("informative", (F.col("n") >= 2) & (F.col("n_a") >= 2))


def in_informative(df: DataFrame, z: list[str] | None = None) -> DataFrame:
    """The rows of informative strata: a semi-join with the stratum table, so no row is held in a window."""
    keys = z or ["z"]
    return df.join(stratum_table(df, keys).filter("informative").select(*keys), keys, "left_semi")


def support(strata: DataFrame) -> DataFrame:
    """One row over a stratum table: units, informative strata, what they retain."""
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("informative"), F.col(c))), F.lit(0))
    return strata.agg(F.sum("n").alias("n"), F.sum("n_a1").alias("n_a1"), F.count("*").alias("n_strata"), F.count_if("informative").alias("n_informative"), kept("n").alias("retained"), kept("n_a1").alias("retained_a1"))


def size_distribution(strata: DataFrame, thin: int = 5) -> DataFrame:
    """Sizes and minority shares over the informative strata of a stratum table."""
    minority = F.least("n_a1", F.col("n") - F.col("n_a1"))
    used = strata.filter("informative").withColumns({"share": minority / F.col("n"), "small": (minority < thin).cast("long")})
    mid = lambda c: F.percentile(c, F.lit(0.5))
    return used.agg(
        F.min("n").alias("n_min"), mid("n").alias("n_median"), F.round(F.avg("n"), 6).alias("n_mean"), F.max("n").alias("n_max"),
        F.round(F.min("share"), 9).alias("share_min"), F.round(mid("share"), 9).alias("share_median"), F.round(F.max("share"), 9).alias("share_max"), F.sum("small").alias("thin"),
    )


def feasibility(df: DataFrame, z: list[str], least_share: float = 0.7, least_strata: int = 20, thin: int = 10) -> DataFrame:
    """Support with gates: enough of the attribute retained, enough informative strata."""
    strata = stratum_table(df, z)
    extra = strata.agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("informative") & (F.col("n") < thin)).alias("thin"))
    out = support(strata).crossJoin(extra)
    share = F.try_divide("retained_a1", "n_a1")
    return out.withColumns({"a1_share": F.round(share, 9), "feasible": F.coalesce((share >= least_share) & (F.col("n_informative") >= least_strata), F.lit(False))})


def cell_table(df: DataFrame, z: list[str], a_values: list) -> DataFrame:
    """A stratum a row, a count column for each attribute value, and what a strata report needs."""
    wide = df.groupBy(*z).pivot("a", a_values).count().na.fill(0)
    counts = [F.col(f"`{v}`") for v in a_values]
    total, some = sum(counts, F.lit(0)), sum(((c > 0).cast("int") for c in counts), F.lit(0))
    names = [c.alias(f"n_{v}") for c, v in zip(counts, a_values, strict=True)]
    out = wide.select(*z, total.alias("n"), *names, some.alias("n_categories"))
    share = F.least(*[F.col(f"n_{v}") for v in a_values]) / F.col("n")
    return out.withColumns({"usable": (F.col("n") >= 2) & (F.col("n_categories") >= 2), "minority_share": F.bround(share, 4)})


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Sizes of clusters, and the per cent of units that share one; a missing cluster is one of its own."""
    sizes = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("k")).select("k").unionByName(df.filter(F.col(cluster).isNull()).select(F.lit(1).cast("long").alias("k")))
    return sizes.agg(
        F.count("*").alias("clusters"), F.percentile("k", F.lit(0.5)).alias("median"), F.round(F.avg("k"), 6).alias("mean"), F.floor(F.percentile("k", F.lit(0.9))).cast("long").alias("q90"), F.max("k").alias("largest"),
        F.bround(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) * 100 / F.sum("k"), 1).alias("pct_shared"),
    )

