"""Deterministic selection by hashes, and proportional allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import selection_key, uniform


def one_per_cluster(df: DataFrame, unit: str, cluster: str, seed: int) -> DataFrame:
    """The unit of least key of every cluster; a missing or empty cluster is the unit's own. Partial aggregation, no window."""
    key = F.coalesce(F.nullif(F.col(cluster).cast("string"), F.lit("")), F.concat(F.lit("__missing__:"), F.col(unit).cast("string")))
    return df.groupBy(key.alias("cluster_key")).agg(F.min_by(unit, selection_key(seed, unit)).alias(unit))


def hamilton(sizes: DataFrame, n: int, size: str = "n", order: str = "z") -> DataFrame:
    """sizes (a row a stratum) with allocated: largest remainders, ties to the later stratum, never over a stratum's size."""
    whole = sizes.agg(F.sum(size).alias("_total"))
    quota = F.lit(n) * F.col(size) / F.col("_total")
    base = sizes.crossJoin(F.broadcast(whole)).withColumn("_quota", quota)
    base = base.withColumns({"_base": F.least(F.floor("_quota"), F.col(size)), "_rest": F.col("_quota") - F.floor("_quota")})
    ranked = base.withColumn("_rank", F.row_number().over(Window.orderBy(F.when(F.col("_base") < F.col(size), 0).otherwise(1), F.desc("_rest"), F.desc(order))))
    short = F.lit(n) - F.sum("_base").over(Window.partitionBy())
    out = ranked.withColumn("allocated", (F.col("_base") + F.when((F.col("_rank") <= short) & (F.col("_base") < F.col(size)), 1).otherwise(0)).cast("long"))
    return out.drop("_total", "_quota", "_base", "_rest", "_rank")


def stratified_sample(df: DataFrame, n: int, seed: int, unit: str = "unit_id", z: str = "z") -> DataFrame:
    """unit and z of a sample without replacement, proportional over strata, by hash order inside each.

    Only the units under each stratum's cut are ranked: a first pass keeps those
    whose hash is under the stratum's share and a margin, so a window never holds a
    whole large stratum. Should a stratum have fewer under its cut than it is to give,
    the margin is widened until none has.
    """
    sizes = hamilton(df.groupBy(z).agg(F.count("*").alias("n")), n, order=z).withColumnRenamed("n", "_n")
    draw = df.join(F.broadcast(sizes), z).withColumn("_u", uniform(f"sample:{seed}", F.col(z), F.col(unit)))
    wide = 6
    while True:
        near = draw.filter(F.col("_u") < (F.col("allocated") + wide * F.sqrt("allocated") + 2 * wide) / F.col("_n"))
        held = near.groupBy(z).agg(F.count("*").alias("_held"))
        if sizes.join(held, z, "left").filter(F.coalesce("_held", F.lit(0)) < F.col("allocated")).isEmpty():
            break
        wide *= 4
    rank = F.row_number().over(Window.partitionBy(z).orderBy("_u", unit))
    return near.withColumn("_rank", rank).filter("_rank <= allocated").select(unit, z)


def shifted(score: Column, down: Column, low: int = 1, high: int = 6) -> Column:
    """score, one less where down holds, within [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), score - F.when(down, 1).otherwise(0)))
