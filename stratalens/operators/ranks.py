"""Running totals, ranks and quantiles over a whole order or inside groups, without a window that one task would have to run.

Values are dealt to about as many ranges as there are shuffle partitions, by
approximate quantiles over all rows; each range of a group is ordered by itself, and
starts from the total of the group's ranges before it. A group that holds a share of
all rows is cut into about that share of the ranges, so no task sees more than a range,
however large a group is. The quantiles decide where ranges end, never a result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edges of ranges that are looked through at a time.
STEP = 10


def _starts(dealt: DataFrame, k, by: list[str]) -> DataFrame:
    """by, _range, its _total of k and _before: that of the group's earlier ranges. A few rows a group."""
    totals = dealt.groupBy(*by, "_range").agg(F.sum(k).alias("_total"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_range", "_total", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))


def _within(k, order: list, by: list[str]):
    """The sum of k over rows of the same range that come before in order."""
    return F.coalesce(F.sum(k).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _placed(dealt: DataFrame, k, order: list, by: list[str], out: str) -> DataFrame:
    """dealt (with _range) with out: the sum of k over rows of the group that come before in range and order."""
    starts = _starts(dealt, k, by).drop("_total")
    placed = dealt.withColumn("_within", _within(k, order, by)).join(starts if by else F.broadcast(starts), [*by, "_range"])
    return placed.withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def _dealt(counts: DataFrame, value: str) -> DataFrame:
    """counts with _range: how many approximate quantiles of all its values are at or below value, by every STEP-th of them, then the next STEP."""
    ranges = max(16, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(max(1000, 4 * ranges)))
    edges = counts.agg(F.array_distinct(cuts).alias("_cuts")).withColumn("_each", F.filter("_cuts", lambda e, i: i % STEP == STEP - 1))
    passed = lambda some: F.size(F.filter(some, lambda e: e <= F.col(value)))
    coarse = counts.crossJoin(F.broadcast(edges)).withColumn("_coarse", STEP * passed("_each"))
    return coarse.withColumn("_range", F.col("_coarse") + passed(F.slice("_cuts", F.col("_coarse") + 1, STEP))).drop("_cuts", "_each", "_coarse")


def with_below(counts: DataFrame, value: str, k: str, out: str, by: list[str] | None = None) -> DataFrame:
    """counts (numeric values, each once a group, with their k) with the sum of k over all smaller values of the group."""
    return _placed(_dealt(counts, value), k, [value], by or [], out)


def counted(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """_value, its rows _k and the rows _below of smaller values, for each group."""
    counts = df.groupBy(*(by or []), F.col(value).alias("_value")).agg(F.count("*").alias("_k"))
    return with_below(counts, "_value", "_k", "_below", by)


def _with_places(df: DataFrame, value: str, by: list[str] | None, place, out: str) -> DataFrame:
    keys = by or []
    placed = counted(df.filter(F.col(value).isNotNull()), value, by).select(*keys, "_value", place.alias(out))
    return df.join(placed.withColumnRenamed("_value", value), [*keys, value])


def numbered(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with out, the place from 1 of each row in its group's order of value (numeric, not null; rows of one value share the first place)."""
    return _with_places(df, value, by, (F.col("_below") + 1).cast("long"), out).select(*df.columns, out)


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with out, the rank of value (numeric, not null) in its group; equal values share the mean of their places."""
    return _with_places(df, value, by, F.col("_below") + (F.col("_k") + 1) / 2, out).select(*df.columns, out)


def in_hash_order(df: DataFrame, key: str, out: str, by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """df with out, the place from 1 of each row in its group's order of key, a hexadecimal digest.

    The key's first digits deal the rows evenly: as many digits as leave about ten thousand
    rows a range, or fewer, of the largest group; rows is a bound on that group, if one is known.
    """
    digits = len(f"{max(1, (rows or df.count()) // 10_000):x}")
    dealt = df.withColumns({"_range": F.substring(key, 1, digits), "_one": F.lit(1).cast("long")})
    return _placed(dealt, "_one", [key], by or [], out).drop("_one").withColumn(out, (F.col(out) + 1).cast("long"))


def quantiles(df: DataFrame, value: str, probabilities: list[float], out: str, by: list[str] | None = None) -> DataFrame:
    """The exact quantiles of value, with linear interpolation, as an array, for each group; one row, null without values, if there are no groups.

    Distinct values are counted and dealt to ranges; only ranges that hold a wanted rank
    are ordered, and of those only the rows that hold one go on, so no task sees all
    values of a group.
    """
    keys = by or []
    dealt = _dealt(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_k")), "_value")
    starts = _starts(dealt, "_k", keys)
    n = starts.groupBy(*keys).agg(F.sum("_total").alias("_n"))
    starts = starts.join(n, keys) if keys else starts.crossJoin(F.broadcast(n))
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]

    def wanted(below: str, k: str):
        holds = lambda rank: (F.col(below) <= rank) & (rank < F.col(below) + F.col(k))
        return holds, reduce(or_, [holds(rank(h)) for h in at for rank in (F.floor, F.ceil)])

    ranges = starts.filter(wanted("_before", "_total")[1]).drop("_total")
    placed = dealt.join(ranges if keys else F.broadcast(ranges), [*keys, "_range"]).withColumn("_below", F.col("_before") + _within("_k", ["_value"], keys))
    holds, some = wanted("_below", "_k")
    few = placed.filter(some)
    pick = lambda rank: F.max(F.when(holds(rank), F.col("_value")))
    row = few.groupBy(*keys).agg(F.max("_n").alias("_n"), *[pick(F.floor(h)).alias(f"lo{i}") for i, h in enumerate(at)], *[pick(F.ceil(h)).alias(f"hi{i}") for i, h in enumerate(at)])
    # between equal values there is nothing to mix: rounded shares of one value need not add up to it
    mixed = [F.when((F.floor(h) == F.ceil(h)) | (F.col(f"lo{i}") == F.col(f"hi{i}")), F.col(f"lo{i}").cast("double")).otherwise((F.ceil(h) - h) * F.col(f"lo{i}") + (h - F.floor(h)) * F.col(f"hi{i}")) for i, h in enumerate(at)]
    return row.select(*keys, F.when(F.col("_n").isNotNull(), F.array(*mixed)).alias(out))
