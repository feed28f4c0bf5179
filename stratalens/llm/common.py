"""Helpers that the corpus operators share.

All per-row Python of this package runs through :func:`append_columns`: Arrow
batches in, the same batches with added columns out, so rows are never regrouped,
counted on or dropped, and repeated rows are as safe as unique ones.
"""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows whose crc32(doc_id as text) mod HELD_OUT_MOD is 0 are never learned from.
HELD_OUT_MOD = 5

#: Most bytes of an Arrow batch while tables are written: whole texts pass through, several tasks a machine.
BATCH_BYTES = 4 << 20

Compute = Callable[[pa.RecordBatch], list[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df less its columns of these names, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as it takes to differ from df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]):
    """What make gives, held for later tasks of this Python worker until another key's takes its place.

    A worker serves many stages; it holds one large thing (an automaton, a tokenizer) at a time.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which its worker gives back the memory it doesn't hold: workers are used again, and idle ones count too."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return tidied


def append_columns(df: DataFrame, fields: list[tuple[str, str]], factory: Callable[[], Compute]) -> DataFrame:
    """df with computed columns after its own.

    ``factory()`` runs once in each task and returns a function from a record
    batch to one array for each of ``fields`` (name, Spark type). A column of df
    that has the name of a new one, in any case, gives way to it.
    """
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    new = {n.lower() for n, _ in fields}
    own = T.StructType([f for f in df.schema.fields if f.name.lower() not in new])
    schema = T.StructType(own.fields + added.fields)
    types = [f.type for f in to_arrow_schema(added)]
    kept = [f.name for f in own.fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        for batch in batches:
            arrays = compute(batch)
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *arrays], names=names)

    return df.mapInArrow(tidy(run), schema)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """The strings of a column, one at a time: a batch's texts are never all Python objects at once."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py()


def bytes_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 of a column's strings, one at a time; null counts as empty."""
    for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()):
        yield x.as_py() or b""


def held_out(doc_id: F.Column | str, mod: int = HELD_OUT_MOD, remainder: int = 0) -> F.Column:
    """True where crc32 of the id's decimal text leaves this remainder (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod == remainder


def is_held_out(doc_id: int | None, mod: int = HELD_OUT_MOD, remainder: int = 0) -> bool:
    """held_out() for one id, for tests."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == remainder


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; without one nothing is written."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again: lineage ends there, and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    with lean(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def lean(spark: SparkSession):
    """What runs inside gets Arrow batches of at most BATCH_BYTES, and shuffle files go with the query that made them.

    The session's own settings are back afterwards.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_BYTES: for results that hold whole texts and are computed by whoever writes them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Intermediate tables in the shared folder, each of which goes as soon as it isn't needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """df written as Parquet and read again: lineage ends there."""
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        with lean(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables from :meth:`keep` that nothing reads any more."""
        for df in tables:
            path, _ = self.paths.pop(id(df))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
