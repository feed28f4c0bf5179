"""From raw documents to token ids, in five stages.

Every stage takes all rows its predecessor kept and passes on the columns of
documents: language identification drops rejected documents; line dedup takes
repeated lines out of texts, and a document out that has lost all its lines with
words; the n-gram join keeps one document of each class of near copies (the first
by doc_id, then by the text's hash; rows equal in both are one document);
decontamination drops documents that hold benchmark passages; BPE gives token ids.

Rows may repeat: equal ones are judged alike, and the n-gram join keeps one of them.
Null texts have no letters and go with the first stage. Columns of documents other
than COLUMNS are left behind. An empty table goes through empty. Stages of Python over
whole texts set the session's Arrow batches to a few MB, since whoever writes a stage's
result computes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches, table
from .op02_line_dedup import dedup_lines
from .op03_ngram_join import keep_one_of_each_class
from .op06_language import fit, identify
from .op07_bpe import encode_decode
from .op10_decontaminate import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = fit(docs.filter(~held_out("doc_id")))
    return identify(docs, model).filter("NOT rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs.select(*COLUMNS)).filter("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each_class(docs.select(*COLUMNS)).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode_decode(docs.select("doc_id", "lang", "source", "text"), with_bytes=True).drop("text")


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_copies), ("decontaminate", benchmark), ("bpe", tokens)]

#: The fitted language model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once its successor is written; the last, token ids, is the result and stays."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
