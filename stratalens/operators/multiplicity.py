"""Holm's step-down adjustment, Wilson intervals and rejection rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The 0.975 quantile of the normal distribution (fixed value).
Z975 = 1.959963984540054


def holm(df: DataFrame, family: list[str], p: str = "p", position: str = "position", alpha: float = 0.05) -> DataFrame:
    """df with p_holm and reject inside each family; ties by position. A family is a table of tests, never of units."""
    order = Window.partitionBy(*family).orderBy(p, position)
    m = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_step", step).withColumn("p_holm", running).drop("_step").withColumn("reject", F.col("p_holm") <= alpha)


def wilson(k: str | Column, n: str | Column, z: float = Z975) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, exactly 0 and 1 at the ends, null without trials."""
    k, n = (F.col(c) if isinstance(c, str) else c for c in (k, n))
    p = F.try_divide(k, n)
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    low = F.when(n > 0, F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)))
    high = F.when(n > 0, F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half)))
    return low, high


def rejection_rates(df: DataFrame, keys: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Share of p at or under alpha, with its interval, for each of keys."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_replicates"), F.count_if(F.col(p) <= alpha).alias("n_rejections"))
    low, high = wilson("n_rejections", "n_replicates")
    return out.withColumns({"rejection_rate": F.col("n_rejections") / F.col("n_replicates"), "ci_low": low, "ci_high": high})


def permutation_p(at_least: Column, b: Column) -> Column:
    return (1 + at_least) / (b + 1)
