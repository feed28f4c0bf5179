"""Lineage cut in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, as spark.checkpoint.dir names it.

    Only where that is unset and the session is local, with driver and executors in
    one process, is a temporary folder taken.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def lean(spark: SparkSession):
    """What runs inside gets Arrow batches of 4 MB, and shuffle files go with the query that made them; the session's own settings are back afterwards."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def written(df: DataFrame):
    """df written to the checkpoint folder as a table that goes once what runs inside has ended."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read again, so that it is computed once however often it is used."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
