"""Text quality by positive-unlabelled learning.

Trusted texts of label 1 are the positives; any other texts of the web are the
unlabelled set, whatever their labels. A linear model g is fitted on the non-negative
unbiased risk pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]) with logistic loss l:
where the second term, the risk of negatives that no label shows, falls under 0, its
gradient is followed upwards instead. The class prior pi is estimated first: a plain
classifier of positives against unlabelled is fitted on one half of the sample, and on
the other half pi is the least ratio, over score thresholds, of the unlabelled to the
positive share above it, with a margin for chance at each (the best-bin estimate). A
score is the logistic function of g: near P(label 1 | text).

Features don't depend on language or words: shares of the trigrams of byte classes
(lower, upper, digit, space, line end, sentence mark, other sign, beyond ASCII), of
words that repeat their predecessor, of different words in windows of WINDOW words,
and the text's length in steps. Texts are read in pieces of PIECE bytes.

Both samples are drawn by a hash of the id over the whole table, about SAMPLE rows
each; the model is fitted in one task of that bound. Null and empty texts have no
trigrams and no words, and are scored by the rest. Null labels teach nothing; several labels of an
id count as their majority, 1 at a tie. Rows may repeat; other columns pass through.
Without a positive, every score is 0.5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, bytes_of, cut, held_out, lean, table

#: Expected rows of the sample of positives, and of that of unlabelled texts.
SAMPLE = 8_000
PIECE = 1 << 16
WINDOW = 100
STEPS = 16
L2 = 1e-4
ROUNDS = 300
THRESHOLD = 0.7
CLASSES = 8
SENTENCE = b".,;:!?'\"()-"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def byte_classes() -> np.ndarray:
    out = np.full(256, 6, np.int16)
    for chars, c in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\v\f\r", 4), (SENTENCE, 5), (bytes(range(128, 256)), 7)):
        out[list(chars)] = c
    return out


CLASS_OF = byte_classes()
#: trigrams, steps of repeats, steps of different words, steps of length
SIZE = CLASSES**3 + 3 * STEPS


def step(share: float) -> int:
    """0 for none, then steps of a share, finer near 0."""
    return 0 if share <= 0 else min(STEPS - 1, 1 + int(np.sqrt(share) * (STEPS - 1)))


def pieces(data: bytes):
    """data in pieces of about PIECE bytes that end at white space."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            found = SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def features(data: bytes) -> np.ndarray:
    """float32 [SIZE] of a text's UTF-8; the memory taken is a few pieces, whatever its length (one word longer than that excepted)."""
    trigrams, words, repeats, before = np.zeros(CLASSES**3, np.int64), 0, 0, None
    window, fresh, windows = [], 0.0, 0
    tail = np.zeros(0, np.int16)
    for i in range(0, len(data), PIECE):
        c = np.concatenate([tail, CLASS_OF[np.frombuffer(data, np.uint8, min(PIECE, len(data) - i), i)]])
        if len(c) > 2:
            trigrams += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        tail = c[-2:]
    for piece in pieces(data):
        own = piece.split()
        if not own:
            continue
        repeats += (before == own[0]) + sum(map(bytes.__eq__, own, own[1:]))
        before = own[-1]
        words += len(own)
        window += own
        full = len(window) - len(window) % WINDOW
        for w in range(0, full, WINDOW):
            fresh, windows = fresh + len(set(window[w : w + WINDOW])) / WINDOW, windows + 1
        window = window[full:]
    if window and not windows:
        fresh, windows = len(set(window)) / len(window), 1
    out = np.zeros(SIZE, np.float32)
    total = trigrams.sum()
    if total:
        out[: CLASSES**3] = np.sqrt(trigrams / total)
    base = CLASSES**3
    if words:
        out[base + step(repeats / words)] = 1
        out[base + STEPS + step(1 - fresh / windows)] = 1
    out[base + 2 * STEPS + min(STEPS - 1, len(data).bit_length())] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def risk(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, float, np.ndarray, float]:
    """Risk of positives, risk of negatives, and the gradient (of w, of b) to follow.

    Without a prior, u is simply the other class, each class of weight 1/2.
    """
    zp, zu = p @ w + b, u @ w + b
    sp, su = sigmoid(zp), sigmoid(zu)
    share = 0.5 if prior is None else prior
    pos, dp = share * softplus(-zp).mean(), share * (sp - 1) / len(p)
    if prior is None:
        neg, du, dn = 0.5 * softplus(zu).mean(), 0.5 * su / len(u), 0.0
    else:
        neg, du, dn = softplus(zu).mean() - prior * softplus(zp).mean(), su / len(u), -prior * sp / len(p)
    if neg < 0:  # overfitted: only the negatives' risk moves, upwards
        gp, gu = -dn, -du
    else:
        gp, gu = dp + dn, du
    return pos, neg, p.T @ gp + u.T @ gu, float(np.sum(gp) + np.sum(gu))


def fit_linear(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int = ROUNDS, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights by accelerated gradient steps on the whole sample."""
    w, b = np.zeros(p.shape[1]), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, _, g, gb = risk(w, b, p, u, prior)
        g = g + 2 * l2 * w
        rate = 0.1 / (1 + t / 100)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        one, two = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / one) / (np.sqrt(v / two) + 1e-8)
        b -= rate * (mb / one) / (np.sqrt(vb / two) + 1e-8)
    return w, b


def estimate_prior(zp: np.ndarray, zu: np.ndarray, chance: float = 0.1) -> float:
    """The best-bin estimate of the positives' share of the unlabelled from held-out scores of both.

    Over every threshold c: the share of zu at least c over that of zp, at the c where
    that ratio plus its margin for chance is least.
    """
    if not len(zp) or not len(zu):
        return 0.5
    margin = np.sqrt(np.log(4 / chance) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    cuts = np.unique(zp)
    above = lambda z: 1 - np.searchsorted(np.sort(z), cuts, side="left") / len(z)
    fp, fu = above(zp), above(zu)
    best = int(np.argmin((fu + margin) / fp))
    return float(np.clip(fu[best] / fp[best], 0.01, 0.99))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, data: bytes) -> float:
        return float(sigmoid(features(data) @ self.weights + self.bias))


def fit_sets(p: np.ndarray, u: np.ndarray, half_p: np.ndarray, half_u: np.ndarray) -> Model:
    """half_p, half_u: the rows that the prior's classifier is fitted on; the others estimate the prior."""
    if not len(p) or not len(u):
        return Model(np.zeros(p.shape[1]), 0.0, 0.5)
    if half_p.any() and half_u.any():
        w, b = fit_linear(p[half_p], u[half_u], None)
        prior = estimate_prior(p[~half_p] @ w + b, u[~half_u] @ w + b)
    else:
        prior = 0.5
    return Model(*fit_linear(p, u, prior), prior)


def samples(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, sample: int) -> DataFrame:
    """text, draw (a hash) and positive of the texts drawn for either set, cut; a text drawn for both is there twice.

    Of a trusted id one text counts, the first by hash, however many rows have the id; unlabelled
    rows are drawn each for itself, equal ones once.
    """
    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30))
    votes = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").groupBy("doc_id").agg((F.avg("label") >= 0.5).alias("trusted")).filter("trusted")
    drawn = cut(votes.filter(hashed("doc_id", F.lit("quality")) < (1 << 30) * min(1.0, sample / max(1, votes.count()))))
    if drawn.count() <= 2 * sample:  # as good as always: the draw's size varies by its square root
        drawn = F.broadcast(drawn)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("draw", hashed("doc_id", "text"))
    trusted = rows.join(drawn, "doc_id").groupBy("doc_id").agg(F.min_by("text", "draw").alias("text"), F.min("draw").alias("draw"))
    share = min(1.0, sample / max(1, docs.count()))
    others = rows.filter(F.col("draw") < (1 << 30) * share).groupBy("doc_id", "text").agg(F.first("draw").alias("draw"))
    return cut(trusted.select("text", "draw", F.lit(True).alias("positive")).unionByName(others.select("text", "draw", F.lit(False).alias("positive"))))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text), the unlabelled texts, and the trusted ones among them by labels (doc_id, label 1). SIZE weights reach the driver."""
    drawn = samples(docs, labels, text, label, doc_id, sample)

    def encoded(batches):
        for pdf in batches:
            yield pd.DataFrame({"one": 0, "draw": pdf["draw"], "positive": pdf["positive"], "x": [features((t or "").encode()).tobytes() for t in pdf["text"]]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "x"], kind="stable")
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), SIZE)
        positive, half = pdf["positive"].to_numpy(bool), pdf["draw"].to_numpy() % 2 == 0
        m = fit_sets(x[positive], x[~positive], half[positive], half[~positive])
        return pd.DataFrame({"w": [m.weights.tolist()], "b": [m.bias], "prior": [m.prior]})

    rows = drawn.mapInPandas(encoded, "one int, draw long, positive boolean, x binary")
    with lean(docs.sparkSession):
        found = rows.groupBy("one").applyInPandas(solve, "w array<double>, b double, prior double").first()  # the bounded sample's group
    return Model(np.array(found["w"]), found["b"], found["prior"]) if found else Model(np.zeros(SIZE), 0.0, 0.5)


def score_quality(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 from threshold)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def compute(batch):
            scores = [m.score(data) for data in bytes_of(batch, text)]
            return [scores, [int(s >= threshold) for s in scores]]

        return compute

    return append_columns(df, [("score", "double"), ("predicted", "int")], factory)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lambda: held_out("doc_id", 4, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~out())
    model = fit(docs.filter(~out()), labels)
    return cut(score_quality(docs, model).select("doc_id", out().alias("held_out"), "score", "predicted"))
