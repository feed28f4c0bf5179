"""Incremental scoring: new units in a stream, each scored once. An extension; the batch form is ScoreStore.append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fake_judge


def score_stream(units: DataFrame, judge: str, text: str = "text", key: str = "unit_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream of responses, one a key; repeats within delay of event time are dropped."""
    once = units.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return once.select(key, ts, F.lit(judge).alias("judge"), F.sha2(text, 256).alias("prompt_sha256"), fake_judge(judge, text).alias("raw_response"))


def windowed_support(units: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Units by window, stratum and attribute, from a stream with late rows."""
    return units.withWatermark(ts, delay).groupBy(F.window(ts, width), "z", "a").agg(F.count("*").alias("n"))
