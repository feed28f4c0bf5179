"""The registry, and the audit bindings of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import audit_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_frame(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", F.col("o_orderstatus") == "F", "o_orderpriority")


ORDERS = "o AS (SELECT o_orderkey AS unit_id, o_totalprice AS s_raw, CAST(o_orderstatus = 'F' AS INT) AS a, o_orderpriority AS z FROM orders)"
#: ... with eight pooled quantile bins
BINNED = f"""{ORDERS},
e AS (SELECT list_distinct(quantile_cont(s_raw, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS e FROM o),
c AS (SELECT o.*, len(list_filter(e, lambda x: x <= s_raw)) AS code FROM o, e),
b AS (SELECT unit_id, s_raw, a, z, CAST(dense_rank() OVER (ORDER BY code) - 1 AS INT) AS s_bin FROM c)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_frame(table(spark, sf_dir, "events"), "event_id", "value", F.col("event_type") == "error", "user_id")


EVENTS = "o AS (SELECT event_id AS unit_id, value AS s_raw, CAST(event_type = 'error' AS INT) AS a, user_id AS z FROM events)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, s_raw, a, lang, quality, source of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("unit_id"), F.col("n_chars").cast("double").alias("s_raw"), F.col("toxic").alias("a"), "lang", "quality", "source")


LABELLED = "o AS (SELECT d.doc_id AS unit_id, CAST(n_chars AS DOUBLE) AS s_raw, toxic AS a, lang, quality, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: no unique id, so for aggregates only."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_quantity").alias("s_raw"), (F.col("l_returnflag") == "R").cast("int").alias("a"), F.concat_ws("|", "l_linestatus", F.col("l_tax").cast("decimal(4,2)").cast("string")).alias("z"))


ITEMS = "o AS (SELECT CAST(l_quantity AS DOUBLE) AS s_raw, CAST(l_returnflag = 'R' AS INT) AS a, l_linestatus || '|' || CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR) AS z FROM lineitem)"
