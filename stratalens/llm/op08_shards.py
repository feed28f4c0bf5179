"""Contiguous shards of nearly equal bytes, from global prefix sums of sizes.

Rows are put in order of id (then text checksum and size; rows equal in all three
are interchangeable) by a range shuffle of their ids and sizes alone, and written
to the checkpoint folder. Each partition's total goes to the driver, one number a
partition; a row's place in the whole is its partition's prefix sum plus its
running sum there. A row belongs to the shard whose equal share of all bytes holds
the row's midpoint, so every shard is within one row's size of its share.

Null text has no bytes (size is the overhead alone) and checksum 0; null ids come
first. Rows of one id may be any share of all: the range shuffle splits them.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, cut, table

OVERHEAD = 16


def byte_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, rows: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the row's place in its shard) of every row; with rows also row, all its columns.

    A partition's rows are in order of shard and slot.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * rows
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body).cast("long") + overhead).alias("size"), F.crc32(body).alias("text_crc32"), *whole)
    parts = max(slim.sparkSession.sparkContext.defaultParallelism, int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # rows alike in every column still differ in the last, so that no range is more than its share
    spread = slim.withColumn("_row", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(parts, "doc_id", "text_crc32", "size", "_row").sortWithinPartitions("doc_id", "text_crc32", "size", "_row")
    fixed = cut(ranged.drop("_row").withColumn("_part", F.spark_partition_id()))

    totals = {r["_part"]: (r["n"], r["bytes"]) for r in fixed.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    ids = sorted(totals)
    rows_before = dict(zip(ids, accumulate((totals[p][0] for p in ids), initial=0), strict=False))
    bytes_before = dict(zip(ids, accumulate((totals[p][1] for p in ids), initial=0), strict=False))
    total = sum(b for _, b in totals.values())

    def factory():
        done = {}  # of each partition in this task: rows and bytes so far

        def compute(batch):
            part, size = batch.column("_part").to_numpy(), batch.column("size").to_numpy()
            place, shard = np.empty(len(part), np.int64), np.empty(len(part), np.int32)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                rows, before = done.get(p, (rows_before[p], bytes_before[p]))
                ends = before + np.cumsum(size[at])
                place[at] = rows + np.arange(len(at))
                # twice the midpoint against twice the total, in whole numbers
                shard[at] = [min(shards - 1, int(x) * shards // (2 * total)) for x in 2 * ends - size[at]]
                done[p] = rows + len(at), int(ends[-1])
            return [place, shard]

        return compute

    placed = append_columns(fixed, [("_place", "long"), ("shard", "int")], factory)
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"), *(["row"] * rows))


def write_shards(docs: DataFrame, path: str, shards: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """docs as Parquet under path/shard=K, each row once, rows of a shard in slot order over files in order of name.

    Whole rows go through the one range shuffle, so ids may be null or repeat, and no
    task holds more than its range. A column of docs named shard or slot gives way.
    """
    placed = byte_shards(docs, shards, doc_id, text, rows=True)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    placed.select(*kept, "shard", "slot").write.partitionBy("shard").parquet(path)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is made a byte at a time from the table of its polynomial, 0xEDB88320.
SQL = r"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM c WHERE k < 8),
t AS (SELECT list(v ORDER BY i) AS steps FROM c WHERE k = 8),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda a, b: xor(a // 256, steps[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM documents, t),
s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS ends, sum(size) OVER () AS total FROM d),
p AS (SELECT doc_id, size, text_crc32, least(39, (2 * ends - size) * 40 // (2 * total)) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
