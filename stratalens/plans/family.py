"""Audits of many attributes over one score and one stratification.

Units are shuffled once, for all attributes: each gives a row for every attribute that
doesn't exclude it (code -1), and these are counted to cells before they leave the map
side. All that follows, observed statistics, support, gaps, nulls and Holm's adjustment
across the family, reads that table of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.multiplicity import holm
from ..operators.ranks import with_below
from ..operators.statistics import g2_terms
from .permutation import TOLERANCE, cells_null
from .power import kolmogorov
from .shared import cut

KEY = ["attribute"]


def family_cells(df: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    """(attribute, z, s_bin, a, n, s_sum) of units (z, s_bin, s_raw); attributes give codes from 0, and -1 or null for units that are no part of that test."""
    codes = F.array(*[F.struct(F.lit(name).alias("attribute"), code.cast("int").alias("a")) for name, code in attributes.items()])
    long = df.select("z", "s_bin", "s_raw", F.inline(codes)).filter("a >= 0")
    return long.groupBy(*KEY, "z", "s_bin", "a").agg(F.count("*").alias("n"), F.sum("s_raw").alias("s_sum"))


def family_observed(cube: DataFrame) -> DataFrame:
    """A row an attribute: units, those of code 1, informative strata and what they retain, conditional_g2 and the weighted mean gap of 1 less 0."""
    terms = g2_terms(cube.select(*KEY, "z", "s_bin", "a", "n"), KEY).groupBy(*KEY).agg(F.sum("term").alias("conditional_g2"))
    one = lambda c, k: F.coalesce(F.sum(F.when(F.col("a") == k, F.col(c))), F.lit(0))
    strata = cube.groupBy(*KEY, "z").agg(F.sum("n").alias("n"), F.count_distinct("a").alias("kinds"), one("n", 1).alias("n1"), one("n", 0).alias("n0"), one("s_sum", 1).alias("s1"), one("s_sum", 0).alias("s0"))
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("kinds") > 1, F.col(c))), F.lit(0))
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    gap = F.try_divide(F.sum(F.when(both, F.col("n") * (F.try_divide("s1", "n1") - F.try_divide("s0", "n0")))), F.sum(F.when(both, F.col("n"))))
    out = strata.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("n1").alias("n_a1"), F.count_if(F.col("kinds") > 1).alias("n_informative"), kept("n").alias("retained"), kept("n1").alias("retained_a1"), gap.alias("gap"))
    return out.join(terms, KEY)


def family_test(df: DataFrame, attributes: dict[str, Column], b: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """family_observed with n_at_least and p_value of conditional_g2 over b draws, and p_holm and reject across the attributes.

    An attribute's draws don't depend on which others are tested beside it.
    """
    cube = cut(family_cells(df, attributes))
    null = cells_null(cube, b, seed, KEY)
    real = family_observed(cube)
    least = F.col("conditional_g2") - TOLERANCE * F.greatest(F.lit(1.0), F.abs("conditional_g2"))
    hits = null.filter("draw > 0").join(real.select(*KEY, "conditional_g2"), KEY).groupBy(*KEY).agg(F.count_if(F.col("value") >= least).alias("n_at_least"))
    out = real.join(hits, KEY).withColumn("p_value", (1 + F.col("n_at_least")) / (b + 1))
    return holm(out.withColumn("_family", F.lit(0)), ["_family"], "p_value", "attribute", alpha).drop("_family")


def control_sweep(cube: DataFrame, relabellings: int, b: int, seed: int) -> DataFrame:
    """(attribute, relabelling, value, p_value): relabellings drawn within strata, each tested against b further draws.

    Where nothing is amiss with ids, strata and counts, the p-values are uniform; see sweep_summary.
    """
    null = cut(cells_null(cube, relabellings + b, seed, KEY))
    least = F.col("value") - TOLERANCE * F.greatest(F.lit(1.0), F.abs("value"))
    asked = null.filter((F.col("draw") > 0) & (F.col("draw") <= relabellings)).select(*KEY, F.col("draw").alias("relabelling"), "value", least.alias("at"))
    marks = asked.select(*KEY, "at", F.lit(0).cast("long").alias("k")).unionByName(null.filter(F.col("draw") > relabellings).select(*KEY, F.col("value").alias("at"), F.lit(1).cast("long").alias("k")))
    below = with_below(marks.groupBy(*KEY, "at").agg(F.sum("k").alias("k")), "at", "k", "below", KEY).select(*KEY, "at", "below")
    return asked.join(below, [*KEY, "at"]).select(*KEY, "relabelling", "value", ((1 + b - F.col("below")) / (b + 1)).alias("p_value"))


def sweep_summary(sweep: DataFrame, b: int, critical: float = 1.628) -> DataFrame:
    """attribute, ks, tests and uniform: whether ks is under the two-sample bound of tests and b draws (critical: for 1 in 100)."""
    return kolmogorov(sweep, "p_value", KEY).withColumn("uniform", F.col("ks") < critical * F.sqrt(1 / F.col("tests") + 1 / b))
