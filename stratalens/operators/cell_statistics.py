"""Pluggable statistics of count cells, any number of them in one pass.

Units reach a statistic as cells (z, s_bin, a) with n, s_sum and s_sq (the sum and the
sum of squares of scores), so one declaration serves observed tables, attribute
families and permuted draws. A statistic is three aggregates, one over another: cells
to groups (z, a), groups to strata, strata to a value. All statistics that are asked
for share these steps: two shuffles of cells at most, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .statistics import RSS_FLOOR

#: Gives the column that the step before declared under a name.
Get = Callable[[str], Column]
SUMS = ("n", "s_sum", "s_sq")


@dataclass(frozen=True)
class CellStatistic:
    """Three functions to aggregate columns.

    value aggregates strata (n, s_sum, s_sq and what stratum declares); stratum
    aggregates groups (a, n, s_sum, s_sq and what cell declares); cell aggregates cells,
    which also have the margins n_z, n_zs and n_za. Declared columns are read through the
    argument, so those of different statistics never meet.
    """

    value: Callable[[Get], Column]
    stratum: Callable[[Get], dict[str, Column]] = lambda get: {}
    cell: Callable[[Get], dict[str, Column]] = lambda get: {}


def cell_frame(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, z, s_bin, a, n, s_sum, s_sq) of units with finite scores: the one shuffle of units."""
    squares = F.sum(F.col("s_raw") * F.col("s_raw"))
    return df.groupBy(*(by or []), "z", "s_bin", "a").agg(F.count("*").alias("n"), F.sum("s_raw").alias("s_sum"), squares.alias("s_sq"))


def wide(cube: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """A row for each of by, with a column for every name; null where a statistic isn't defined, and in the one row of an empty table without keys."""
    keys, asked = by or [], {name: cell_statistic(name) for name in dict.fromkeys(names)}
    get = lambda name: lambda part: F.col(f"_{name}_{part}")
    over = lambda *c: F.sum("n").over(Window.partitionBy(*keys, "z", *c))
    totals = [F.sum(c).alias(c) for c in SUMS]

    def declared(step: str) -> list[Column]:
        return [c.alias(f"_{name}_{part}") for name, s in asked.items() for part, c in getattr(s, step)(get(name)).items()]

    of_cells = declared("cell")
    if of_cells:
        cube = cube.withColumns({"n_z": over(), "n_zs": over("s_bin"), "n_za": over("a")})
    groups = cube.groupBy(*keys, "z", "a").agg(*totals, *of_cells)
    strata = groups.groupBy(*keys, "z").agg(*totals, *declared("stratum"))
    return strata.groupBy(*keys).agg(*[s.value(get(name)).cast("double").alias(name) for name, s in asked.items()])


def long(cube: DataFrame, names: list[str], by: list[str] | None = None, out: str = "observed") -> DataFrame:
    """wide as rows (by, statistic, out)."""
    names = list(dict.fromkeys(names))
    pairs = ", ".join(f"'{name}', `{name}`" for name in names)
    return wide(cube, names, by).selectExpr(*(by or []), f"stack({len(names)}, {pairs}) AS (statistic, {out})")


def _g2(get: Get) -> dict[str, Column]:
    ratio = F.col("n") * (F.col("n_z") / (F.col("n_zs").cast("double") * F.col("n_za")))
    return {"g2": F.sum(2 * F.col("n") * F.ln(ratio))}


def _kept(get: Get) -> dict[str, Column]:
    return {"g2": F.sum(get("g2"))}


def _spread(get: Get) -> dict[str, Column]:
    mean = F.col("s_sum") / F.col("n")
    return {"spread": F.max(mean) - F.min(mean)}


def _left() -> Column:
    """The squares about the mean of what a row sums over."""
    return F.expr("s_sq - s_sum * s_sum / n")


def _lrt(get: Get) -> Column:
    floor = lambda c: F.greatest(c, F.lit(RSS_FLOOR))
    return F.sum("n") * F.ln(floor(F.sum(_left())) / floor(F.sum(get("within"))))


def _of(a: int, c: Column) -> Column:
    return F.max(F.when(F.col("a") == a, c))


def _contrast(c: Column) -> dict[str, Column]:
    """The difference of c between groups 1 and 0 of a stratum; null where either has no unit."""
    return {"d": _of(1, c) - _of(0, c)}


def _weighted(get: Get) -> Column:
    d = get("d")
    return F.try_divide(F.sum(F.col("n") * d), F.sum(F.when(d.isNotNull(), F.col("n"))))


CELL_STATISTICS: dict[str, CellStatistic] = {
    "conditional_g2": CellStatistic(lambda get: F.sum(get("g2")), _kept, _g2),
    "conditional_mi": CellStatistic(lambda get: F.sum(get("g2")) / (2 * F.sum("n")), _kept, _g2),
    "mean_disparity": CellStatistic(lambda get: F.sum(F.col("n") * get("spread")) / F.sum("n"), _spread),
    "regression_lrt": CellStatistic(_lrt, lambda get: {"within": F.sum(_left())}),
    "weighted_gap": CellStatistic(_weighted, lambda get: _contrast(F.expr("s_sum / n"))),
    "variance_gap": CellStatistic(_weighted, lambda get: _contrast(F.expr("s_sq / n - (s_sum / n) * (s_sum / n)"))),
}


def register_cells(name: str, statistic: CellStatistic) -> None:
    """Add a statistic: observed tables, families and permutation tests then take its name."""
    if not name.isidentifier():
        raise ValueError(f"a statistic's name becomes a column; {name!r} can't")
    CELL_STATISTICS[name] = statistic


def cell_statistic(name: str) -> CellStatistic:
    try:
        return CELL_STATISTICS[name]
    except KeyError:
        raise ValueError(f"no statistic of cells called {name!r}; there are {sorted(CELL_STATISTICS)}") from None
