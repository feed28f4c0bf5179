"""Scoring by any callable, spread over tasks: retries, batches with rescue of single items, and resumption."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered

#: Tries after the first, and rows of a model's batch.
RETRIES, BATCH = 3, 32


class Transient(Exception):
    """A scorer's failure that may pass: rate limits, server errors, lost connections."""


def with_retries(score: Callable[[str], str], prompt: str, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """Response, retries used, error. Transient failures wait 2**k seconds and a little more; others raise."""
    for k in range(retries + 1):
        try:
            return score(prompt), k, None
        except Transient as e:
            if k == retries:
                return None, k, str(e)
            sleep(2**k + random.random())
    raise AssertionError


def score_each(units: DataFrame, make: Callable[[], Callable[[str], str]], judge: str, condition: str, prompt: str = "prompt", key: str = "unit_id") -> DataFrame:
    """A record for every unit, in the score store's columns. make() gives a task its scorer (and connection)."""

    def work(batches):
        score = make()
        for pdf in batches:
            rows = [with_retries(score, p) for p in pdf["prompt"]]
            yield pd.DataFrame({"unit_id": pdf["unit_id"], "raw_response": [r[0] for r in rows], "retry_count": [r[1] for r in rows], "error_status": [r[2] for r in rows], "prompt_sha256": pdf["sha"]})

    slim = units.select(F.col(key).cast("string").alias("unit_id"), F.col(prompt).alias("prompt"), F.sha2(prompt, 256).alias("sha"))
    out = slim.mapInPandas(work, "unit_id string, raw_response string, retry_count int, error_status string, prompt_sha256 string")
    return out.withColumns({"judge": F.lit(judge), "condition": F.lit(condition)})


def score_batches(units: DataFrame, make: Callable[[], Callable[[list[str]], list[float]]], text: str = "text", key: str = "unit_id", size: int = BATCH) -> DataFrame:
    """unit_id, score, status. A batch that fails is scored item by item; an item that fails has no score."""

    def work(batches):
        model = make()

        def one(t: str) -> tuple[float | None, str]:
            try:
                return float(model([t])[0]), "ok_rescued"
            except Exception as e:  # noqa: BLE001  (whatever a model raises is that item's status)
                return None, f"error: {type(e).__name__}"

        for pdf in batches:
            texts, out = pdf["text"].tolist(), []
            for i in range(0, len(texts), size):
                part = texts[i : i + size]
                try:
                    out += [(float(x), "ok") for x in model(part)]
                except Exception:  # noqa: BLE001
                    out += [one(t) for t in part]
            yield pd.DataFrame({"unit_id": pdf["unit_id"], "score": [s for s, _ in out], "status": [s for _, s in out]})

    slim = units.select(F.col(key).cast("string").alias("unit_id"), F.col(text).alias("text"))
    return slim.mapInPandas(work, "unit_id string, score double, status string")


def _digests(placed: DataFrame, key: str, span: int, out: str) -> DataFrame:
    """A digest of each range of span places: its ids in order."""
    listed = F.array_sort(F.collect_list(F.struct("_place", F.col(key).cast("string").alias("id"))))  # span of them at most
    text = F.concat_ws("\n", F.transform(listed, lambda r: F.concat_ws(":", r["_place"], F.coalesce(r["id"], F.lit("")))))
    return placed.groupBy(F.floor((F.col("_place") - 1) / span).alias("_range")).agg(F.sha2(text, 256).alias(out))


def resumable(done: DataFrame, targets: DataFrame, order: str, key: str, target_order: str, size: int = BATCH, span: int = 4096) -> DataFrame:
    """The rows of done, in order, up to the last whole batch; ValueError where their ids aren't the first of targets, in order.

    order numbers the log's rows and target_order the targets (numeric, each value
    once). Both are placed by ranges and compared by a digest for each span of
    places: a changed, missing, added or reordered id shows in its range.
    """
    placed = numbered(done, order, "_place")
    whole = done.count() // size * size
    kept = placed.filter(F.col("_place") <= whole)
    wanted = numbered(targets.select(F.col(target_order).alias("_order"), F.col(key).alias("_id")), "_order", "_place").filter(F.col("_place") <= whole)
    both = _digests(kept, key, span, "_own").join(_digests(wanted, "_id", span, "_want"), "_range", "full")
    bad = both.filter(~F.col("_own").eqNullSafe(F.col("_want"))).agg(F.min("_range").alias("r")).first()["r"]
    if bad is not None:
        raise ValueError(f"the log is not the beginning of the targets: rows {bad * span + 1} to {(bad + 1) * span} differ")
    return kept.drop("_place")
