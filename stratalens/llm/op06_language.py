"""Language identification by nearest centroid.

Letters of a text, in lower case with single spaces between words, give character
n-grams of one to three, hashed into DIMS places. A text's vector is its
sublinear counts times inverse document frequencies, scaled to length one. Each
language's training vectors are clustered (spherical k-means) into up to CLUSTERS
centroids; a text takes the language of the centroid of the largest cosine. A text
further from that centroid than nearly all training texts of the language, by a
margin, is rejected.

The model is fitted on a sample of at most about SAMPLE_PER_LANG labelled rows a
language, taken by a hash of id and text over the whole table, a text once, one task
a language. Every language is learned; the model grows with their number alone.

Null text and text without letters: ``und``, score 0, rejected. Ties go to the
first language by name. Null languages are not learned; without any training row
every text is ``und``. Rows may repeat, other columns pass through.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, append_columns, held_out, lean, table, texts_of

DIMS = 4096
CLUSTERS = 4
#: Characters of a text whose n-grams are made at once.
BLOCK = 1 << 18
#: Bound on the rows a language's centroids are fitted on (expected value of the hash sample).
SAMPLE_PER_LANG = 600
#: A text is rejected below this part of a low quantile of the cosines of its language's training texts.
REJECT_PART, REJECT_QUANTILE = 0.5, 0.01
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for code points that are letters."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)], bool)


def features(text: str | None, block: int = BLOCK) -> np.ndarray | None:
    """Counts of hashed n-grams, float32 [DIMS]; None without letters. Any length is taken whole, block characters at a time."""
    if not text:
        return None
    text, letters = text.lower(), _letters()
    out = np.zeros(DIMS, np.int64)
    # the last two codes go before the next block's, whose n-grams begin there
    run, counted, after_letter, any_letter = np.array([32], np.uint64), 0, True, False
    for at in range(0, len(text), block):
        codes = np.frombuffer(text[at : at + block].encode("utf-32-le"), np.uint32)
        letter = letters[codes]
        keep = letter | np.r_[after_letter, letter[:-1]]  # one space after each word
        after_letter, any_letter = letter[-1], any_letter or letter.any()
        run = np.concatenate((run, np.where(letter, codes, 32)[keep], [32] * (at + block >= len(text)))).astype(np.uint64)
        h = run * np.uint64(0x9E3779B97F4A7C15)
        for n in (1, 2, 3):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + run[n - 1 :]
            if len(h) == 0:
                break
            place = ((h[max(0, counted - n + 1) :] * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.int64) % DIMS
            out += np.bincount(place, minlength=DIMS)
        run = run[-2:]
        counted = len(run)
    return out.astype(np.float32) if any_letter else None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # [centroids, DIMS]
    owner: np.ndarray  # of each centroid: place in langs
    least: np.ndarray  # of each language: the cosine under which a text is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = features(text)
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, True
        v = vector(counts, self.idf)
        cosine = self.centroids @ v
        best = int(cosine.argmax())
        lang, score = int(self.owner[best]), float(min(1.0, max(0.0, cosine[best])))
        return self.langs[lang], score, score < self.least[lang]


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: unit centroids and each vector's cosine with its own."""
    seeds = [int((vectors @ vectors.sum(0)).argmax())]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centroids = vectors[seeds].copy()
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(1)
        for c in range(len(centroids)):
            if (own == c).any():
                total = vectors[own == c].sum(0)
                centroids[c] = total / max(np.sqrt(total @ total), 1e-12)
    return centroids, (vectors @ centroids.T).max(1)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE_PER_LANG) -> Model:
    """A model of labelled rows. What reaches the driver is CLUSTERS centroids a language."""
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.greatest(F.approx_count_distinct(F.xxhash64("doc_id", "text")), F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    # rows of one id and text may be any share of all: they are drawn together and count once
    scratch = Scratch(rows.sparkSession)
    drawn = scratch.keep(rows.join(counts, "lang").filter(draw < sample / F.col("n")).groupBy("lang", "text").agg(F.first("doc_id").alias("any")).select("text", "lang"))

    def document_counts(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                if (x := features(t)) is not None:
                    seen += x > 0
                    n += 1
        yield pd.DataFrame({"seen": [seen.tolist()], "n": [n]})

    parts = drawn.mapInPandas(document_counts, "seen array<long>, n long")
    total = parts.agg(F.sum("n").alias("n")).first()["n"] or 0
    seen = {r["pos"]: r["s"] for r in parts.select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    df = np.array([seen.get(i, 0) for i in range(DIMS)], np.float64)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def centroids_of(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [x for x in map(features, pdf["text"]) if x is not None]
        if not found:
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "centroid": pd.Series([], dtype=object), "least": pd.Series([], dtype=float)})
        vectors = np.stack([vector(x, shared.value) for x in found])
        centroids, cosine = cluster(vectors, CLUSTERS)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.tolist() for c in centroids], "least": float(np.quantile(cosine, REJECT_QUANTILE)) * REJECT_PART})

    with lean(rows.sparkSession):
        found = drawn.groupBy("lang").applyInPandas(centroids_of, "lang string, centroid array<float>, least double").collect()
    scratch.drop(drawn)
    langs = sorted({r["lang"] for r in found})
    found.sort(key=lambda r: (r["lang"], list(r["centroid"])))
    least = {r["lang"]: r["least"] for r in found}
    centroids = np.array([r["centroid"] for r in found], np.float32).reshape(len(found), DIMS)
    return Model(langs, idf, centroids, np.array([langs.index(r["lang"]) for r in found], int), np.array([least[x] for x in langs]))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score (the cosine) and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def compute(batch):
            rows = [m.predict(t) for t in texts_of(batch, text)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]

        return compute

    return append_columns(df, [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")], factory)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out("doc_id")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
