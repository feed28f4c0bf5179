"""Toxicity by a counterfactually regularised classifier.

Features of a text: its words, and their beginnings and ends of three to six
letters, each once a text. Of all that occur in at least MIN_DOCS training texts,
the KEEP most telling by chi-square are kept, and those of identity terms whatever
they tell, so that the second penalty has them to act on. A logistic model of their presence
is fitted with two penalties: on squared weights, and on the squared change of a
sentence's score when its identity terms are swapped for those of another group.
The second holds the score still where only the group mentioned differs, so that
neutral mentions of a group are not taken for abuse of it.

The training set is a sample of at most about SAMPLE labelled rows, taken by a
hash of the id over the whole table; features are counted by a shuffle over all of
them, and the weights fitted in one task of bounded size.

Null and empty texts have no features and the score of none. Null labels teach
nothing. Without training rows every score is under 1e-12. Rows may repeat, other columns
pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, cut, held_out, table, texts_of

#: Bound on labelled rows that the classifier is fitted on (expected value of the hash sample).
SAMPLE = 24_000
MIN_DOCS = 4
KEEP = 4096
L2 = 2e-4
#: Weight of the squared change of a swapped sentence's score.
COUNTERFACTUAL = 1.0
ROUNDS = 300

#: Groups of identity terms; a term is swapped for that of the next group of its row (fixed values).
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("african", "european", "american", "mexican", "chinese", "arab"), ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("disabled", "abled"),
)
SWAP = {t: row[(i + 1) % len(row)] for row in IDENTITY for i, t in enumerate(row)}
WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> list[str]:
    out = [word]
    for n in (3, 4, 5, 6):
        if len(word) > n:
            out += [f"{word[:n]}*", f"*{word[-n:]}"]
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        """Each kept feature counts once, however many words bring it."""
        known, found = self.known, set()
        for w in words_of(text):
            hits = known.get(w)
            if hits is None:
                hits = tuple(f for f in features_of(w) if f in self.weights)
                if len(known) > 400_000:
                    known.clear()
                if len(w) <= 40:
                    known[w] = hits
            if hits:
                found.update(hits)
        z = self.bias + sum(sorted(self.weights[f] for f in found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_weights(sets: list[list[int]], swapped: list[list[int]], labels: np.ndarray, n_features: int, l2: float = L2, counterfactual: float = COUNTERFACTUAL, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic weights by full-batch accelerated gradient steps.

    loss = mean(log loss) + l2 * |w|^2 + counterfactual * mean((z - z')^2) over the
    sentences with a swap, z' being the score's argument after it. Rows of sets
    and swapped are numbers of present features; swapped rows without change are equal.
    """
    def matrix(rows):
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return at, np.fromiter((f for r in rows for f in r), np.int64, len(at))

    n = len(sets)
    changed = [i for i in range(n) if set(sets[i]) != set(swapped[i])]
    at, col = matrix(sets)
    gained = matrix([sorted(set(swapped[i]) - set(sets[i])) for i in changed])
    lost = matrix([sorted(set(sets[i]) - set(swapped[i])) for i in changed])
    y = np.asarray(labels, np.float64)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if 0 < y.mean() < 1 else np.ones(n)
    balance = np.sqrt(balance)
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(at, w[col], n)
        d = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(col, d[at], n_features) + 2 * l2 * w
        if changed:
            delta = np.bincount(gained[0], w[gained[1]], len(changed)) - np.bincount(lost[0], w[lost[1]], len(changed))
            k = 2 * counterfactual * delta / len(changed)
            g += np.bincount(gained[1], k[gained[0]], n_features) - np.bincount(lost[1], k[lost[0]], n_features)
        gb, rate = d.sum(), 0.1 / (1 + step / 100)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return w, b


def sample_of(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, sample: int) -> DataFrame:
    """text and label of about sample labelled documents, one row an id, cut.

    Ids are drawn from the labels by hash and sent to the documents, so only drawn
    texts move. Several labels of an id become one, toxic if half of them are; of
    several texts of an id the least is taken.
    """
    votes = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    votes = votes.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = cut(votes.filter(draw < min(1.0, sample / max(1, votes.count()))))
    if drawn.count() <= 2 * sample:  # as good as always: the draw's size varies by its square root
        drawn = F.broadcast(drawn)
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(drawn, "doc_id")
    return cut(joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", doc_id: str = "doc_id", sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model of docs (doc_id, text) labelled by labels (doc_id, label 0 or 1). What reaches the driver is bounded by KEEP weights and those of IDENTITY."""
    drawn = sample_of(docs, labels, text, label, doc_id, sample)
    context = docs.sparkSession.sparkContext

    def occurring(batches):
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["label"], strict=True):
                found = list(text_features(words_of(t)))
                yield pd.DataFrame({"f": [*found, ""], "y": np.int64(y)})

    seen = drawn.mapInPandas(occurring, "f string, y long").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    named = sorted(text_features(set(SWAP)))
    seen = cut(seen.filter((F.col("n") >= MIN_DOCS) | F.col("f").isin("", *named)))
    top = seen.filter("f = ''").first()  # the empty feature is in every text
    if top is None:
        return Model({}, -30.0)
    texts, toxic = top["n"], top["pos"]
    expected = F.col("n") * (toxic / texts)
    chi2 = (F.col("pos") - expected) ** 2 / F.greatest(expected * (1 - toxic / texts), F.lit(1e-9))
    kept = seen.filter(f"f <> '' AND n >= {MIN_DOCS}").withColumn("chi2", chi2).orderBy(F.desc("chi2"), "f").limit(KEEP).select("f").collect()
    kept += seen.filter(F.col("f").isin(named)).select("f").collect()
    names = sorted({r["f"] for r in kept})
    shared = context.broadcast({f: i for i, f in enumerate(names)})

    def encoded(batches):
        index = shared.value
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                words = words_of(t)
                swapped = {SWAP.get(w, w) for w in words}
                sets = [sorted(index[f] for f in text_features(ws) if f in index) for ws in (words, swapped)]
                out.append((sets[0], sets[1] if swapped != words else sets[0]))
            yield pd.DataFrame({"one": "", "own": [a for a, _ in out], "swapped": [b for _, b in out], "label": pdf["label"]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = fit_weights([list(x) for x in pdf["own"]], [list(x) for x in pdf["swapped"]], pdf["label"].to_numpy(), len(names), counterfactual=counterfactual)
        return pd.DataFrame({"w": [w.tolist()], "b": [b]})

    codes = drawn.mapInPandas(encoded, "one string, own array<int>, swapped array<int>, label int")
    result = codes.groupBy("one").applyInPandas(solve, "w array<double>, b double").first()  # the bounded sample's group
    return Model(dict(zip(names, result["w"], strict=True)), result["b"])


def score_toxicity(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5)."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def factory():
        m = Model(*shared.value)

        def compute(batch):
            scores = [m.score(t) for t in texts_of(batch, text)]
            return [scores, [int(s >= 0.5) for s in scores]]

        return compute

    return append_columns(df, [("score", "double"), ("predicted", "int")], factory)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(~held_out("doc_id"))
    model = fit(docs, labels)
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
