"""Files of verbatim strings, keyed scans, checksums."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as they are in the file; quoted fields may hold line feeds."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\0", emptyValue="")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_report(path: str, payload) -> None:
    """A small report: indented, keys sorted, anything else as text."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest order for each key, by partial aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first for each key combination, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """name and sha256 of the files under path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def verified(df: DataFrame, spark: SparkSession, path: str, sha256: str, rows: int) -> DataFrame:
    """df, refused where the file at path isn't the one recorded or has other than so many rows."""
    found = {r["sha256"] for r in checksums(spark, path).collect()}
    if found != {sha256} or df.count() != rows:
        raise ValueError(f"{path} is not the recorded file")
    return df


def covered(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right; ValueError where right lacks a key of left."""
    if not left.join(right, key, "left_anti").isEmpty():
        raise ValueError(f"some {key} of the left side are not on the right")
    return left.join(right, key)


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side alone: (key, side)."""
    one = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return one(left, right, "left").unionByName(one(right, left, "right"))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new's keys replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
