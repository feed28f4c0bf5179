"""Audit frames: a DataFrame of units with a score, an attribute and a stratum.

Canonical columns: unit_id (unique), s_raw (double), s_bin (int, from 0), a (int
code from 0) and z (any type). Functions that must not see the attribute take and
return frames without it; see :func:`blind`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import barrier

DECIMAL = "decimal(38,18)"
#: Columns that scoring and binning may not receive.
FORBIDDEN = frozenset({"a", "attribute", "ell_status", "gender", "race_ethnicity"})


def audit_frame(df: DataFrame, unit_id, s_raw, a, z) -> DataFrame:
    """unit_id, s_raw, a, z of df; arguments are columns or names."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(unit_id).alias("unit_id"), col(s_raw).cast("double").alias("s_raw"), col(a).cast("int").alias("a"), col(z).alias("z"))


def blind(df: DataFrame) -> DataFrame:
    """df, refused if it has a column that A-free stages may not see, by name or computed from one by that name."""
    if seen := FORBIDDEN & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(seen)} must not reach this stage")
    return barrier(df, FORBIDDEN)


def violations(df: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for a valid frame, in one pass over it."""
    infinite = F.abs("s_raw") == F.lit(float("inf"))
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("s_raw").isNull() | F.isnan("s_raw") | infinite).alias("bad_score"),
        F.count_if(F.col("a").isNull() | (F.col("a") < 0)).alias("bad_attribute"),
        F.count_if(F.col("z").isNull()).alias("bad_stratum"),
        (F.count("*") - F.count_distinct("unit_id")).alias("repeated_ids"),
    )


def validate(df: DataFrame, codes: dict[str, int] | None = None) -> DataFrame:
    """df itself; ValueError where it is empty or a count of violations isn't 0, or a code leaves [0, k)."""
    found = violations(df).first().asDict()
    if not found.pop("n") or any(found.values()):
        raise ValueError(f"not a sample: {found}")
    if codes:
        ranges = df.agg(*[F.min(c).alias(f"{c}_min") for c in codes], *[F.max(c).alias(f"{c}_max") for c in codes]).first()
        for c, k in codes.items():
            if ranges[f"{c}_min"] < 0 or ranges[f"{c}_max"] >= k:
                raise ValueError(f"{c} leaves [0, {k})")
    return df


def stripped(c: str) -> Column:
    """A string less white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where none of the columns is null or blank."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.coalesce(stripped(c), F.lit("")) != "")
    return df.filter(keep)


def exact(c: str | Column) -> Column:
    """A decimal from text, never by way of a double."""
    return (F.col(c) if isinstance(c, str) else c).cast("string").cast(DECIMAL)


def at_least_half(c) -> Column:
    return (exact(c) >= F.lit("0.5").cast(DECIMAL)).cast("int")


def high_confidence(c) -> Column:
    """1 from 4/5, 0 at 0, null between."""
    return F.when(exact(c) >= F.lit("0.8").cast(DECIMAL), 1).when(exact(c) == 0, 0)


def level_bin(c) -> Column:
    """0; up to 1/4; under 1/2; under 3/4; the rest: 0 to 4."""
    x = exact(c)
    return F.when(x == 0, 0).when(x <= F.lit("0.25").cast(DECIMAL), 1).when(x < F.lit("0.5").cast(DECIMAL), 2).when(x < F.lit("0.75").cast(DECIMAL), 3).otherwise(4)


def coarse_bin(c) -> Column:
    """0; under 1/2; the rest: 0 to 2."""
    x = exact(c)
    return F.when(x == 0, 0).when(x < F.lit("0.5").cast(DECIMAL), 1).otherwise(2)


def composite_key(*columns: Column) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in columns])


def any_at_least_half(*columns) -> Column:
    return (F.greatest(*[exact(c) for c in columns]) >= F.lit("0.5").cast(DECIMAL)).cast("int")
