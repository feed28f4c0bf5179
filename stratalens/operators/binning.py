"""A-free score bins.

Quantiles are exact with linear interpolation. Codes of quantile bins count the
edges at or below a value; tertile and median bins send a value on an edge down.
Edges are few, so they are attached as one broadcast row (pooled) or joined on the
stratum, and found by ranks over counted values, never by a window over a stratum's units; codes are made dense over the distinct codes, never by a global window
over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .frame import blind
from .ranks import quantiles, with_below


def edges(df: DataFrame, n_bins: int, s: str = "s_raw", by: list[str] | None = None) -> DataFrame:
    """The distinct inner edges of n_bins quantile bins, for each group or one row over all units; no task gathers their values."""
    if n_bins < 2:
        raise ValueError("at least two bins are needed")
    return quantiles(df, s, [k / n_bins for k in range(1, n_bins)], "_edges", by).withColumn("_edges", F.array_distinct("_edges"))


def code(edge: Column, s: Column) -> Column:
    return F.size(F.filter(edge, lambda e: e <= s))


def dense(df: DataFrame, column: str, out: str, few: bool = False) -> DataFrame:
    """df with the rank, from 0, of column among its distinct values, joined back.

    Numbers are ranked in ranges, however many there are; other types, and columns that
    the caller knows to have few values, in one window over those.
    """
    values = df.select(column).distinct()
    if isinstance(df.schema[column].dataType, T.NumericType) and not few:
        ranks = with_below(values.withColumn("_k", F.lit(1).cast("long")), column, "_k", out).select(column, F.col(out).cast("int").alias(out))
    else:
        ranks = values.withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(ranks, column)


def _blind_of(df: DataFrame) -> DataFrame:
    return blind(df.drop("a"))


def quantile_bins(df: DataFrame, n_bins: int = 8, s: str = "s_raw", out: str = "s_bin") -> DataFrame:
    """df with pooled quantile bins; the edges come from the scores alone."""
    pooled = edges(_blind_of(df), n_bins, s)
    coded = df.crossJoin(F.broadcast(pooled)).withColumn("_code", code(F.col("_edges"), F.col(s)))
    return dense(coded, "_code", out, few=True).drop("_code", "_edges")  # n_bins codes at most


def stratum_bins(df: DataFrame, n_bins: int = 8, s: str = "s_raw", out: str = "s_bin") -> DataFrame:
    """df with quantile bins inside each z; codes are made dense over all strata together."""
    own = edges(_blind_of(df), n_bins, s, ["z"])
    coded = df.join(own, "z").withColumn("_code", code(F.col("_edges"), F.col(s)))
    return dense(coded, "_code", out, few=True).drop("_code", "_edges")  # n_bins codes at most


def identity_bins(df: DataFrame, s: str = "s_raw", out: str = "s_bin") -> DataFrame:
    """df with the rank of the score rounded half to even."""
    return dense(df.withColumn("_code", F.rint(s)), "_code", out).drop("_code")


def discretize(df: DataFrame, strategy: str = "global", n_bins: int = 8) -> DataFrame:
    try:
        return {"global": lambda: quantile_bins(df, n_bins), "within": lambda: stratum_bins(df, n_bins), "identity": lambda: identity_bins(df)}[strategy]()
    except KeyError:
        raise ValueError(f"no binning called {strategy!r}") from None


def decile_codes(df: DataFrame, s: str = "s_raw", out: str = "s_bin") -> DataFrame:
    """df with codes 0 to 9 from pooled deciles; a value on an edge goes up."""
    pooled = edges(_blind_of(df), 10, s)
    return df.crossJoin(F.broadcast(pooled)).withColumn(out, code(F.col("_edges"), F.col(s))).drop("_edges")


def fixed_cuts(cuts: tuple[float, ...], value: Column) -> Column:
    return sum(((value >= F.lit(c)).cast("int") for c in cuts), F.lit(0))


def within_groups(df: DataFrame, q: str, by: str, tertile: str = "tertile", half: str = "half") -> DataFrame:
    """df with the thirds (0, 1, 2) and halves (0, 1) of q inside by; a value on an edge goes down, a null has no bin."""
    df, columns = df.withColumn("_group", F.struct(by)), df.columns  # a struct: rows without by are a group too
    at = quantiles(df, q, [1 / 3, 1 / 2, 2 / 3], "_at", ["_group"])
    x = F.col(q)
    third = F.when(x <= F.col("_at")[0], 0).when(x <= F.col("_at")[2], 1).when(x.isNotNull(), 2)
    return df.join(at, "_group", "left").withColumns({tertile: third, half: (x > F.col("_at")[1]).cast("int")}).select(*columns, tertile, half)
