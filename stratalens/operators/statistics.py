"""Stratified statistics as aggregates.

All start from one shuffle to a table of cells (a stratum's bins or attributes);
margins are windows over that small table, never joins with the units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import chi2_sf, f_sf, t_two_sided

#: Residual sums are held above this before a logarithm is taken.
RSS_FLOOR = 1e-300


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def cells(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n of every (z, s_bin, a) that occurs, by further keys."""
    return df.groupBy(*(by or []), "z", "s_bin", "a").agg(F.count("*").alias("n"))


def with_margins(cube: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    over = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    return cube.withColumns({"n_z": over("z"), "n_zs": over("z", "s_bin"), "n_za": over("z", "a")})


def margins(df: DataFrame) -> DataFrame:
    """The cube and its three margins in one table, by grouping sets; what is summed over is null."""
    view = df.select("z", "s_bin", "a")
    sets = [[F.col("z"), F.col("s_bin"), F.col("a")], [F.col("z"), F.col("s_bin")], [F.col("z"), F.col("a")], [F.col("z")]]
    return view.groupingSets(sets, "z", "s_bin", "a").agg(F.count("*").alias("n"))


def g2_terms(cube: DataFrame, by: list[str] | None = None) -> DataFrame:
    """cube with each cell's term of conditional G2. Cells that don't occur add nothing."""
    ratio = F.col("n") * F.col("n_z") / (F.col("n_zs") * F.col("n_za"))
    return with_margins(cube, by).withColumn("term", 2 * F.col("n") * F.ln(ratio.cast("double")))


def conditional_g2(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = g2_terms(cells(df, by), by).groupBy(*(by or [])).agg(F.sum("term").alias("g2"), F.sum("n").alias("n"))
    return out.select(*(by or []), F.col("g2").alias("conditional_g2"), "n")


def conditional_mi(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return conditional_g2(df, by).withColumn("conditional_mi", F.col("conditional_g2") / (2 * F.col("n"))).drop("conditional_g2")


def mean_disparity(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Spread of attribute means in a stratum, weighted by strata's share of all units."""
    keys = by or []
    groups = df.groupBy(*keys, "z", "a").agg(F.avg("s_raw").alias("m"), F.count("*").alias("n"))
    strata = groups.groupBy(*keys, "z").agg((F.max("m") - F.min("m")).alias("spread"), F.sum("n").alias("n"))
    return strata.groupBy(*keys).agg((F.sum(F.col("n") * F.col("spread")) / F.sum("n")).alias("mean_disparity"), F.sum("n").alias("n"))


def residual_sums(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rss0 (strata alone) and rss1 (strata and attribute) with cells and strata, in centred form."""
    keys = by or []
    groups = df.groupBy(*keys, "z", "a").agg(F.count("*").alias("n"), F.avg("s_raw").alias("m"), (F.var_pop("s_raw") * F.count("*")).alias("ss"))
    strata = groups.groupBy(*keys, "z").agg(F.sum("ss").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"), F.collect_list(F.struct("n", "m")).alias("groups"))
    between = F.aggregate("groups", F.lit(0.0), lambda acc, g: acc + g["n"] * (g["m"] - F.col("centre")) * (g["m"] - F.col("centre")))
    return strata.withColumn("between", between).groupBy(*keys).agg(
        F.greatest(F.sum(F.col("within") + F.col("between")), F.lit(RSS_FLOOR)).alias("rss0"), F.greatest(F.sum("within"), F.lit(RSS_FLOOR)).alias("rss1"), F.sum("n").alias("n"), F.sum("k").alias("cells"), F.count("*").alias("strata")
    )


def regression_lrt(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = residual_sums(df, by)
    return out.select(*(by or []), (F.col("n") * F.ln(F.col("rss0") / F.col("rss1"))).alias("regression_lrt"), "n")


#: Statistics by name: functions of an audit frame and further keys to one row for each key.
STATISTICS: dict[str, Callable[..., DataFrame]] = {"conditional_g2": conditional_g2, "conditional_mi": conditional_mi, "mean_disparity": mean_disparity, "regression_lrt": regression_lrt}


def register(name: str, statistic: Callable[..., DataFrame]) -> None:
    """Add a statistic; it must give a column of its own name for each of the keys it is passed."""
    STATISTICS[name] = statistic


def statistic(name: str) -> Callable[..., DataFrame]:
    try:
        return STATISTICS[name]
    except KeyError:
        raise ValueError(f"no statistic called {name!r}; there are {sorted(STATISTICS)}") from None


def observed(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of (keys, statistic, observed)."""
    keys = by or []
    parts = [statistic(n)(df, keys).select(*keys, F.lit(n).alias("statistic"), F.col(n).cast("double").alias("observed")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def welch(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Two-group Welch t, its degrees of freedom and two-sided p, for each of by; groups of under two left out; null where they aren't two."""
    keys = by or []
    groups = df.groupBy(*keys, "a").agg(F.count("*").alias("n"), F.avg("s_raw").alias("m"), F.var_samp("s_raw").alias("v")).filter("n >= 2")
    row = groups.groupBy(*keys).agg(F.count("*").alias("groups"), F.min_by("n", "a").alias("n0"), F.max_by("n", "a").alias("n1"), F.min_by("m", "a").alias("m0"), F.max_by("m", "a").alias("m1"), F.min_by("v", "a").alias("v0"), F.max_by("v", "a").alias("v1"))
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    two = F.col("groups") == 2
    out = row.select(
        *keys,
        "groups",
        F.when(two, F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(e0 + e1))).alias("t"),
        F.when(two, F.try_divide((e0 + e1) * (e0 + e1), e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1))).alias("df"),
    )
    return out.withColumn("p_value", t_two_sided("t", "df"))


def alexander_govern(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The Alexander-Govern statistic of more than two groups of unequal variance, its degrees of freedom and p, for each of by."""
    keys = by or []
    groups = df.groupBy(*keys, "a").agg(F.count("*").alias("n"), F.avg("s_raw").alias("m"), (F.var_samp("s_raw") / F.count("*")).alias("e")).filter("n >= 2 AND e > 0")
    whole = groups.groupBy(*keys).agg((F.sum(F.col("m") / F.col("e")) / F.sum(1 / F.col("e"))).alias("centre"))
    t = (F.col("m") - F.col("centre")) / F.sqrt("e")
    nu = F.col("n") - 1
    a, b = nu - 0.5, 48 * (nu - 0.5) ** 2
    c = F.sqrt(a * F.ln(1 + t * t / nu))
    z = c + (c**3 + 3 * c) / b - (4 * c**7 + 33 * c**5 + 240 * c**3 + 855 * c) / (10 * b**2 + 8 * b * c**4 + 1000 * b)
    placed = groups.join(whole, keys) if keys else groups.crossJoin(F.broadcast(whole))
    return placed.groupBy(*keys).agg(F.sum(z * z).alias("statistic"), (F.count("*") - 1).alias("df")).withColumn("p_value", chi2_sf("statistic", "df"))


def stratified_f(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F of the attribute inside strata, its degrees of freedom and p, for each of by; null F where either is not positive or nothing is left to explain."""
    r = residual_sums(df, by)
    num, den = F.col("cells") - F.col("strata"), F.col("n") - F.col("cells")
    f = ((F.col("rss0") - F.col("rss1")) / num) / (F.col("rss1") / den)
    out = r.select(*(by or []), num.alias("df_num"), den.alias("df_den"), F.when((num > 0) & (den > 0) & (F.col("rss1") > RSS_FLOOR), f).alias("f"))
    return out.withColumn("p_value", f_sf("f", "df_num", "df_den"))


def moments(df: DataFrame) -> DataFrame:
    """n, mean, population variance, skewness and excess kurtosis of every (z, a) of at least two units."""
    out = df.groupBy("z", "a").agg(F.count("*").alias("n"), F.avg("s_raw").alias("mean"), F.var_pop("s_raw").alias("variance"), F.skewness("s_raw").alias("skewness"), F.kurtosis("s_raw").alias("excess_kurtosis"))
    return out.filter("n >= 2")


def detectable(df: DataFrame) -> DataFrame:
    """Conditional mutual information against ten times its bias bound, cells / 2n."""
    cube = cells(df)
    count = cube.agg(F.count("*").alias("cells"))
    out = conditional_mi(df).crossJoin(count).withColumn("bias_bound", F.col("cells") / (2 * F.col("n")))
    return out.withColumn("detectable", F.col("conditional_mi") > 10 * F.col("bias_bound"))
