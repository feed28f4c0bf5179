"""Weighted contrasts between attribute groups inside strata, all on one kernel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contrast_table(df: DataFrame, values: dict[str, Column], z: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """For every informative stratum: n, and the difference (a = 1 less a = 0) of each value's mean."""
    one = lambda c, k: F.avg(F.when(F.col("a") == k, c.cast("double")))
    count = lambda k: F.count_if(F.col("a") == k)
    keys = [*(by or []), *(z or ["z"])]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), count(0).alias("n0"), count(1).alias("n1"), *[(one(c, 1) - one(c, 0)).alias(v) for v, c in values.items()])
    return out.filter("n0 > 0 AND n1 > 0")


def weighted(df: DataFrame, values: dict[str, Column], z: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Contrasts weighted by informative strata's units; null where there is none, and the units and strata used."""
    table = contrast_table(df, values, z, by)
    sums = [F.try_divide(F.sum(F.col("n") * F.col(v)), F.sum("n")).alias(v) for v in values]
    return table.groupBy(*(by or [])).agg(*sums, F.coalesce(F.sum("n"), F.lit(0)).alias("n_used"), F.count("*").alias("strata_used"))


def mean_gap(df: DataFrame, z: list[str] | None = None, by: list[str] | None = None, s: str = "s_raw") -> DataFrame:
    return weighted(df, {"gap": F.col(s)}, z, by)


def diagnostics(df: DataFrame, levels: range = range(2, 7)) -> DataFrame:
    """Weighted differences of mean, population variance and P(S >= k)."""
    shifts = {f"shift_{k}": (F.col("s_raw") >= k).cast("double") for k in levels}
    table = contrast_table(df, {"mean_diff": F.col("s_raw"), **shifts})
    var = lambda k: F.var_pop(F.when(F.col("a") == k, F.col("s_raw")))
    spread = df.groupBy("z").agg((var(1) - var(0)).alias("variance_diff"))
    joined = table.join(spread, "z")
    return joined.agg(*[F.try_divide(F.sum(F.col("n") * F.col(v)), F.sum("n")).alias(v) for v in ("mean_diff", "variance_diff", *shifts)])


def missing_bounds(df: DataFrame, low: float, high: float) -> DataFrame:
    """Gap with missing scores imputed against and for group 1, over all strata that have both groups."""
    lower = F.coalesce("s_raw", F.when(F.col("a") == 1, F.lit(float(low))).otherwise(F.lit(float(high))))
    upper = F.coalesce("s_raw", F.when(F.col("a") == 1, F.lit(float(high))).otherwise(F.lit(float(low))))
    out = weighted(df, {"lower": lower, "upper": upper})
    return out.withColumns({"zero_in_interval": (F.col("lower") <= 0) & (F.col("upper") >= 0), "sign_guaranteed": (F.col("lower") > 0) | (F.col("upper") < 0)})


def imputation_grid(df: DataFrame, scores: range) -> DataFrame:
    """The gap for every pair of scores given to the missing of either group: one aggregate, no copies of rows."""
    values = {}
    for i in scores:
        for j in scores:
            values[f"g_{i}_{j}"] = F.coalesce("s_raw", F.when(F.col("a") == 1, F.lit(float(i))).otherwise(F.lit(float(j))))
    row = weighted(df, values)
    pairs = ", ".join(f"{i}, {j}, g_{i}_{j}" for i in scores for j in scores)
    return row.selectExpr(f"stack({len(values)}, {pairs}) AS (s_a1, s_a0, gap)")


def decomposition(df: DataFrame, primary: list[str], augmented: list[str]) -> DataFrame:
    """Change of the gap from primary to augmented strata, split into composition and conditioning.

    Common support: the units of augmented strata with both groups. total =
    composition + conditioning; the relative change is null at a gap of 0.
    """
    strata = contrast_table(df, {}, augmented).select(*augmented)
    common = df.join(strata, augmented, "left_semi")
    gap = lambda d, z, name: mean_gap(d, z).select(F.col("gap").alias(name))
    out = gap(df, primary, "primary_gap").crossJoin(gap(common, primary, "primary_common")).crossJoin(mean_gap(df, augmented).select(F.col("gap").alias("augmented_gap"), F.col("n_used").alias("n_common")))
    return out.withColumns({
        "composition": F.col("primary_common") - F.col("primary_gap"), "conditioning": F.col("augmented_gap") - F.col("primary_common"), "total": F.col("augmented_gap") - F.col("primary_gap"),
        "relative": F.try_divide(F.col("augmented_gap") - F.col("primary_gap"), F.col("primary_gap")),
    })


def prediction_check(cells: DataFrame, primary: str, augmented: str, material: float = 0.05, most: float = 0.15) -> DataFrame:
    """Whether the gap of cells hardly changes: the median of |relative change| among cells with |primary| of at least material.

    One row: cells (all), material_cells, median_change (null without any) and
    holds, whether it is under most. A table of results, a row a cell.
    """
    change = F.abs((F.col(augmented) - F.col(primary)) / F.col(primary))
    shown = F.when(F.abs(primary) >= material, change)
    out = cells.agg(F.count("*").alias("cells"), F.count(shown).alias("material_cells"), F.percentile(shown, F.lit(0.5)).alias("median_change"))
    return out.withColumn("holds", F.col("median_change") < most)


def attenuation(gaps: DataFrame, base: str) -> DataFrame:
    """gaps (coding, gap) with the difference from base's, and that as per cent of it."""
    reference = gaps.filter(F.col("coding") == base).select(F.col("gap").alias("base_gap"))
    out = gaps.crossJoin(F.broadcast(reference)).withColumn("difference", F.col("gap") - F.col("base_gap"))
    return out.withColumn("pct", F.bround(F.try_divide(F.col("difference") * 100, F.col("base_gap")), 1)).drop("base_gap")
