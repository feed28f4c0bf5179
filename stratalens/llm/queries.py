"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_toxicity, op02_line_dedup, op03_ngram_join, op04_secrets, op05_urls, op06_language, op07_bpe, op08_shards, op09_media, op10_decontaminate, op11_quality, op12_divergence, op13_negatives, pipeline

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline.run,
        "op1_toxicity": op01_toxicity.op1_toxicity,
        "op2_line_dedup": op02_line_dedup.op2_line_dedup,
        "op3_ngram_join": op03_ngram_join.op3_ngram_join,
        "op4_secrets": op04_secrets.op4_secrets,
        "op5_urls": op05_urls.op5_urls,
        "op6_language": op06_language.op6_language,
        "op7_bpe": op07_bpe.op7_bpe,
        "op8_shards": op08_shards.op8_shards,
        "op9_media": op09_media.op9_media,
        "op10_decontaminate": op10_decontaminate.op10_decontaminate,
        "op11_quality": op11_quality.op11_quality,
        "op12_divergence": op12_divergence.op12_divergence,
        "op13_negatives": op13_negatives.op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": op02_line_dedup.SQL, "op3_ngram_join": op03_ngram_join.SQL, "op5_urls": op05_urls.SQL, "op8_shards": op08_shards.SQL,
        "op10_decontaminate": op10_decontaminate.SQL, "op12_divergence": op12_divergence.SQL, "op13_negatives": op13_negatives.SQL,
    }
