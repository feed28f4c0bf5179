"""An append-only store of raw responses, frozen by checksums before it may be read.

Records are JSON lines in folders judge=J/condition=C. A key (judge, condition,
unit) is written once; freezing records each file's digest, after which appends
are refused; reading is refused unless frozen and unchanged.

The folder may be on any file system that Spark's readers reach; all that changes it
goes through Hadoop's FileSystem. A writer first creates a file LOCK-... of its own and
goes on only if it then sees no other: of two that begin at once, at least one sees the
other, on any file system whose listings are consistent (creating one file exclusively is
not atomic on all of them). It writes its rows beside the records and renames whole files
into place, so a writer that dies leaves no half file, and its lock has to be removed by
hand. A file's
digest is the sum of its lines' SHA-256, piece by piece, with the numbers of lines and
bytes: it is made in parallel over parts of a file, of any size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strict_score
from .files import checksums

KEY = ["judge", "condition", "unit_id"]
SCHEMA = "unit_id string, prompt_sha256 string, raw_response string, request_id string, error_status string, provider_model string, provider_request_id string, prompt_tokens long, completion_tokens long, thinking_tokens long, retry_count int, timestamp_utc string, judge string, condition string"


class Frozen(RuntimeError):
    pass


class Busy(RuntimeError):
    """Another writer holds the store's lock."""


class ScoreStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.data, self.manifest, self.lock = f"{self.root}/records", f"{self.root}/FROZEN.json", f"{self.root}/LOCK"
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _there(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    @contextmanager
    def _locked(self) -> Iterator[None]:
        """Inside, no other writer changes the store."""
        own = self._path(f"{self.lock}-{uuid.uuid4().hex}")
        self.fs.create(own, False).close()
        try:
            if len(self.fs.globStatus(self._path(f"{self.lock}*"))) > 1:
                raise Busy(f"another writer holds {self.lock}")
            yield
        finally:
            self.fs.delete(own, False)

    def records(self) -> DataFrame:
        """All records, without the freeze's guard; empty where nothing has been written."""
        if not self._there(self.data):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.data)

    def append(self, new: DataFrame) -> int:
        """Write rows of new keys; ValueError for keys that are repeated or there already. Gives the number of rows."""
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        rows = new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in columns])
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        with self._locked():
            if self._there(self.manifest):
                raise Frozen("the store is frozen")
            try:
                rows.write.partitionBy("judge", "condition").json(staged)
                written = self.spark.read.schema(SCHEMA).json(staged)
                counts = written.groupBy(*KEY).agg(F.count("*").alias("k")).agg(F.sum("k").alias("rows"), F.count("*").alias("keys")).first()
                if (counts["rows"] or 0) != counts["keys"] or not written.join(self.records().select(*KEY), KEY, "left_semi").isEmpty():
                    raise ValueError("a key may be written once")
                self._move(staged)
            finally:
                self.fs.delete(self._path(staged), True)
        return counts["keys"]

    def _move(self, staged: str) -> None:
        """Renames the staged files into their folders; Spark gave each a name of its own."""
        found = self.fs.listFiles(self._path(staged), True)
        root = self.fs.makeQualified(self._path(staged)).toUri().getPath()
        while found.hasNext():
            file = found.next().getPath()
            if file.getName().endswith(".json"):
                to = self._path(self.data + file.toUri().getPath()[len(root) :])
                self.fs.mkdirs(to.getParent())
                if not self.fs.rename(file, to):
                    raise OSError(f"{file} could not be moved to {to}")

    def missing(self, targets: DataFrame) -> DataFrame:
        """What is left to do: targets (judge, condition, unit_id) without a record."""
        return targets.join(self.records().select(*KEY), KEY, "left_anti")

    def _files(self) -> dict[str, str]:
        """The digest of each file under records, by its path there."""
        sizes, found = {}, self.fs.listFiles(self._path(self.data), True) if self._there(self.data) else None
        root = self.fs.makeQualified(self._path(self.data)).toUri().getPath() + "/"
        while found and found.hasNext():
            status = found.next()
            name = status.getPath().toUri().getPath()
            if name.endswith(".json"):
                sizes[name[len(root) :]] = status.getLen()
        if not sizes:
            return {}
        lines = self.spark.read.option("recursiveFileLookup", "true").text(self.data).select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("sha"))
        piece = lambda i: F.sum(F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
        sums = lines.groupBy("path").agg(F.concat_ws(".", F.count("*"), *[piece(i) for i in range(8)]).alias("digest"))
        decode = self.spark._jvm.java.net.URI
        digests = {decode(r["path"]).getPath()[len(root) :]: r["digest"] for r in sums.collect()}  # a row a file
        return {name: f"{size}.{digests.get(name, '0')}" for name, size in sorted(sizes.items())}

    def freeze(self) -> None:
        with self._locked():
            if self._there(self.manifest):
                raise Frozen("the store is frozen already")
            part = f"{self.manifest}.part"
            out = self.fs.create(self._path(part), True)
            out.write(bytearray(json.dumps({"files": self._files()}, indent=2, sort_keys=True).encode()))
            out.close()
            self.fs.rename(self._path(part), self._path(self.manifest))

    def verify(self) -> None:
        if not self._there(self.manifest):
            raise Frozen("the store is not frozen")
        recorded = "\n".join(r[0] for r in self.spark.read.text(self.manifest, wholetext=True).collect())
        if json.loads(recorded)["files"] != self._files():
            raise ValueError("the store has changed since it was frozen")

    def read(self, judge: str | None = None, condition: str | None = None) -> DataFrame:
        self.verify()
        out = self.records()
        for column, value in (("judge", judge), ("condition", condition)):
            out = out.filter(F.col(column) == value) if value else out
        return out


def verify_prompts(records: DataFrame, prompts: DataFrame, retries: int = 3) -> DataFrame:
    """A row a judge and condition: records, those whose stored hash is that of the prompt rendered anew, and what is amiss.

    prompts holds condition, unit_id and prompt. A record without a prompt is unknown;
    a failure should show all its retries, a success who answered and the tokens used.
    """
    again = prompts.select("condition", F.col("unit_id").cast("string").alias("unit_id"), F.sha2("prompt", 256).alias("again"))
    failed = F.coalesce("error_status", F.lit("")) != ""
    named = (F.coalesce("provider_model", F.lit("")) != "") & (F.coalesce("provider_request_id", F.lit("")) != "") & (F.coalesce("prompt_tokens", F.lit(0)) > 0)
    joined = records.join(again, ["condition", "unit_id"], "left")
    return joined.groupBy("judge", "condition").agg(
        F.count("*").alias("records"), F.count_if(F.col("again") == F.col("prompt_sha256")).alias("hash_ok"), F.count_if(F.col("again").isNotNull() & ~F.col("again").eqNullSafe(F.col("prompt_sha256"))).alias("hash_bad"), F.count_if(F.col("again").isNull()).alias("unknown"),
        F.count_if(failed).alias("failures"), F.count_if(failed & (F.coalesce("retry_count", F.lit(0)) != retries)).alias("failures_without_retries"), F.count_if(~failed & ~named).alias("successes_without_source"),
    )


def classify(records: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    """records with score and outcome: technical (an error), invalid (no score) or ok. The response is parsed anew."""
    error = F.coalesce("error_status", F.lit("")) != ""
    score = strict_score("raw_response", low, high)
    return records.withColumns({"score": F.when(~error, score), "outcome": F.when(error, "technical").when(score.isNull(), "invalid").otherwise("ok")})


def usage(records: DataFrame, price_in: float, price_out: float, bill_thinking: bool = False) -> DataFrame:
    """Calls, tokens, retries and cost a judge and condition."""
    out_tokens = F.coalesce("completion_tokens", F.lit(0)) + (F.coalesce("thinking_tokens", F.lit(0)) if bill_thinking else 0)
    cost = F.bround(F.sum(F.coalesce("prompt_tokens", F.lit(0))) / 1e6 * price_in + F.sum(out_tokens) / 1e6 * price_out, 2)
    return records.groupBy("judge", "condition").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("tokens_in"), F.sum(out_tokens).alias("tokens_out"), F.sum("retry_count").alias("retries"), F.count_if(F.coalesce("error_status", F.lit("")) != "").alias("errors"), cost.alias("cost"))


__all__ = ["Busy", "Frozen", "ScoreStore", "checksums", "classify", "usage", "verify_prompts"]
