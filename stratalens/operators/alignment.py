"""Agreement of two ordinal scores y and s of 1..k, from their confusion counts.

Everything is a function of at most k * k counts: one shuffle of the units, then
small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import quantiles, with_below


def grid(df: DataFrame, *dims: tuple[str, int]) -> DataFrame:
    """All combinations of 1..k of each dim, as a table of its own."""
    out = df.sparkSession.range(1).select()
    for name, k in dims:
        out = out.crossJoin(df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias(name)))
    return out


def confusion(df: DataFrame, k: int = 6, y: str = "y", s: str = "s") -> DataFrame:
    """(y, s, n) over the full grid, zeros kept."""
    counts = df.groupBy(F.col(y).cast("int").alias("y"), F.col(s).cast("int").alias("s")).agg(F.count("*").alias("n"))
    return grid(df, ("y", k), ("s", k)).join(counts, ["y", "s"], "left").na.fill(0, ["n"])


def matrix(df: DataFrame, k: int = 6) -> DataFrame:
    """The confusion counts as one row of arrays."""
    rows = confusion(df, k).groupBy("y").agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("r"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "r"))), lambda g: F.transform(g["r"], lambda c: c["n"])).alias("matrix"))


def weighted_kappa(df: DataFrame, k: int = 6) -> DataFrame:
    """Quadratic weighted kappa; null where either score never varies and they agree by chance alone."""
    table = confusion(df, k)
    total = F.sum("n").over(Window.partitionBy())
    expected = F.sum("n").over(Window.partitionBy("y")) * F.sum("n").over(Window.partitionBy("s")) / total
    weight = (F.col("y") - F.col("s")) ** 2
    return table.select(weight.alias("w"), "n", expected.alias("e")).agg((1 - F.try_divide(F.sum(F.col("w") * F.col("n")), F.sum(F.col("w") * F.col("e")))).alias("qwk"))


def metrics(df: DataFrame) -> DataFrame:
    """Exact and within-one agreement, errors, and entropy, effective levels and top-two share of s."""
    d = F.col("s") - F.col("y")
    errors = df.agg(
        F.count("*").alias("n"), F.avg((d == 0).cast("int")).alias("exact"), F.avg((F.abs(d) <= 1).cast("int")).alias("within_1"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.min("s").alias("s_min"), F.max("s").alias("s_max"), F.corr(F.col("y").cast("double"), F.col("s").cast("double")).alias("pearson"),
    )
    levels = df.groupBy("s").agg(F.count("*").alias("k")).withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy()))
    shape = levels.agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.aggregate(F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, 2), F.lit(0.0), lambda a, x: a + x).alias("top2"))
    return errors.crossJoin(shape).withColumn("effective_levels", F.pow(F.lit(2.0), F.col("entropy")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks. Ranks are of distinct values, weighted by their counts."""

    def ranks(c: str, out: str) -> DataFrame:
        counts = df.groupBy(c).agg(F.count("*").alias("_k"))
        return with_below(counts, c, "_k", "_below").select(c, (F.col("_below") + (F.col("_k") + 1) / 2).alias(out))

    return df.join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y).agg(F.corr("_rx", "_ry").alias("spearman"))


def distribution(df: DataFrame, k: int, by: str = "a", s: str = "s") -> DataFrame:
    """by, and counts of scores 1..k as an array, categories that don't occur included."""
    counts = df.groupBy(by, F.col(s).cast("int").alias("s")).agg(F.count("*").alias("n"))
    full = df.select(by).distinct().crossJoin(grid(df, ("s", k))).join(counts, [by, "s"], "left").na.fill(0, ["n"])
    return full.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda c: c["n"]).alias("counts"))


def summary(df: DataFrame, c: str) -> DataFrame:
    """Order statistics, mean, sample deviation and distinct values of a column, from ranks of its counted values: no task holds all of them."""
    names = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    at = quantiles(df, c, list(names.values()), "_at").select(*[F.col("_at")[i].alias(p) for i, p in enumerate(names)])
    unique = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_k")).agg(F.count("*").alias("n_unique"))
    whole = df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    return whole.crossJoin(at).crossJoin(unique).select("min", *names, "max", "mean", "sd", "n_unique")


__all__ = ["confusion", "distribution", "grid", "matrix", "metrics", "spearman", "summary", "weighted_kappa"]
