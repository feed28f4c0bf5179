"""Quality by positive-unlabelled learning, source divergence, hard negatives: brute force, odd rows, empty tables."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stratalens.llm import op11_quality, op12_divergence, op13_negatives
from stratalens.llm import queries as corpus
from stratalens.llm.common import is_held_out, table

# ---- quality


def test_gradient_of_both_branches_is_that_of_the_risk():
    rng = np.random.default_rng(5)
    p, u = rng.normal(size=(7, 4)), rng.normal(size=(11, 4))
    seen = set()
    for shift in (0.0, 6.0):
        w, b = rng.normal(size=4), 0.3
        p2 = p + shift * np.sign(w)  # far positives: the negatives' risk falls under 0
        _, neg, g, gb = op11_quality.risk(w, b, p2, u, 0.6)
        seen.add(neg < 0)
        target = lambda w, b: (lambda r: -r[1] if neg < 0 else r[0] + r[1])(op11_quality.risk(w, b, p2, u, 0.6))  # noqa: B023, E731
        e = 1e-6
        numeric = [(target(w + e * d, b) - target(w - e * d, b)) / (2 * e) for d in np.eye(4)]
        assert np.allclose(g, numeric, atol=1e-6) and abs(gb - (target(w, b + e) - target(w, b - e)) / (2 * e)) < 1e-6
    assert seen == {True, False}


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(11)
    zp = rng.normal(3, 1, 4000)
    zu = np.r_[rng.normal(3, 1, int(8000 * share)), rng.normal(-3, 1, 8000 - int(8000 * share))]
    assert abs(op11_quality.estimate_prior(zp, zu) - share) < 0.037  # the margin for chance at these sizes


def test_features_of_any_length_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["Ab", "ab", "ü!", "7", "x" * 50, "\n"], 60_000)).encode()
    assert len(text) > 3 * op11_quality.PIECE
    found = op11_quality.features(text)
    c = op11_quality.CLASS_OF[np.frombuffer(text, np.uint8)].astype(int)
    trigrams = np.bincount(c[:-2] * 64 + c[1:-1] * 8 + c[2:], minlength=512)
    words = text.split()
    assert np.allclose(found[:512], np.sqrt(trigrams / trigrams.sum()), atol=1e-6)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    assert found[512 + op11_quality.step(repeats)] == 1
    n = len(words) - len(words) % 100
    fresh = np.mean([len(set(words[i : i + 100])) / 100 for i in range(0, n, 100)])
    assert found[528 + op11_quality.step(1 - fresh)] == 1 and found.sum() == pytest.approx(found[:512].sum() + 3)
    one_word = op11_quality.features(b"x" * 200_000)
    assert one_word[0] == 1 and np.isfinite(one_word).all()


def test_scores_of_held_out_documents(spark):
    d = DATA.replace("sf0.001", "sf0.01")
    found = {r["doc_id"]: r for r in corpus.queries()["op11_quality"](spark, d).collect()}
    docs, labels = table(spark, d, "documents").count(), table(spark, d, "labels").collect()
    assert len(found) == docs and all(r["held_out"] == is_held_out(i, 4, 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in found.items())
    held = [x for x in labels if is_held_out(x["doc_id"], 4, 2)]
    good, bad = ([found[x["doc_id"]]["score"] for x in held if x["quality"] == q] for q in (1, 0))
    better = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert better > 0.97 and sum(g >= 0.7 for g in good) >= 0.97 * len(good)


def test_labels_of_zero_and_of_held_out_rows_are_never_learned_from(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    labels = table(spark, DATA, "labels").select("doc_id", F.col("quality").alias("label"))
    whole, positives = op11_quality.fit(docs, labels), op11_quality.fit(docs, labels.filter("label = 1"))
    assert np.array_equal(whole.weights, positives.weights) and whole.prior == positives.prior


def test_quality_of_odd_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "a " * 100_000), (4, "Straße 中文"), (4, "Straße 中文"), (4, "another")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(4, 1), (4, 1), (4, 0), (None, 1), (1, 1), (2, None), (9, 1)], "doc_id long, label int")
    model = op11_quality.fit(docs, labels)
    out = op11_quality.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == len(rows)
    assert all(r["score"] == pytest.approx(model.score((r["text"] or "").encode())) for r in out.collect())
    none = op11_quality.fit(docs, labels.limit(0))
    assert not none.weights.any() and none.score(b"any") == 0.5
    empty = op11_quality.fit(docs.limit(0), labels)
    assert empty.prior == 0.5 and op11_quality.score_quality(docs.limit(0), empty).count() == 0


# ---- source divergence


def brute_audit(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted({r[2] for r in rows if r[1] == lang})
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 1), n + len(kept))) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items[:limit])}
    return out


def audited(df, **kw):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in op12_divergence.audit_sources(df, **kw).collect()}


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["the", "The", "Über", "é", "中文", "a", "b", "c", "zz", "x1y", "K"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), ["en", "de", None, ""][rng.integers(4)], [None, "s1", "s2", "S1"][rng.integers(4)]) for _ in range(80)]
    rows += [(None, "fr", "s1"), ("only once", "fr", "s2"), ("", "it", "s1"), ("same same", "xx", "s"), ("same", "xx", "s"), ("same", "xx", "s")] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, 5, "v") for r in rows], "text string, lang string, source string, value int, ITEM string")
    assert audited(df) == brute_audit(rows)
    assert audited(df, min_docs=1, top=2) == brute_audit(rows, 1, 2)
    assert audited(df.limit(0)) == set()


def test_ties_at_the_last_rank_expand_in_utf8_order(spark):
    rows = [(" ".join(f"{c}{d}" for c in "zyxwé中" for d in "abcdefgh"), "en", "s1")] * 3 + [("za za other", "en", "s2")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for top in (1, 5, 47, 48, 60):
        assert audited(df, top=top) == brute_audit(rows, 3, top)


# ---- hard negatives


def brute_negatives(rows, anchors):
    """rows: (id, label, vector) as they take part; anchors: ids."""
    ok = [(i, x, [floor(256 * c) for c in v]) for i, x, v in rows if None not in (i, x, v) and all(c is not None and isfinite(c) for c in v)]
    out = []
    for a in sorted({i for i, _, _ in ok if i in anchors}):
        _, label, own = min((r for r in ok if r[0] == a), key=lambda r: (str(r[1]), r[2]))
        score = lambda v: sum(x * y for x, y in zip(own, v, strict=False))  # noqa: B023, E731
        order = sorted({(-score(v), i, x == label) for i, x, v in ok if i != a})
        positives = [(i, -s) for s, i, same in order if same][:5]
        for p, ps in positives:
            found = [(i, -s) for s, i, same in order if not same and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(found)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in op13_negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect())


@pytest.mark.parametrize("scale, block_bytes", [(1.0, 1 << 20), (1e6, 1 << 20), (1.0, 400)])
def test_negatives_equal_brute_force(spark, scale, block_bytes):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(130, 6)) * scale
    vectors[100:] = vectors[3]  # ties
    rows = [(int(i), int(i) % 3, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    want = brute_negatives(rows, {i for i, _, _ in rows if i % 10 == 0})
    assert len(want) > 100 and mined(df, block_bytes=block_bytes) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, "a", [1.0, 0.0]), (10, "a", [1.0]), (1, "a", [0.9, 0.1]), (2, "b", [0.5, 0.5]), (2, "b", [0.5, 0.5]), (3, "b", [0.5, 0.5]), (4, None, [1.0, 1.0]), (5, "b", None), (6, "b", [nan, 1.0]),
            (7, "b", [0.7, None]), (8, "b", [inf, 0.0]), (None, "b", [0.6, 0.6]), (20, "c", []), (21, "c", [0.0, -1.0]), (22, "d", [0.0, 1.0]), (0, "b", [0.4, 0.4]), (11, "b", [0.8, 0.0, 5.0])]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, label string, embedding array<double>, RANK string")
    assert mined(df) == brute_negatives(rows, {0, 10, 20})
    assert mined(df.limit(0)) == []


def test_scores_past_long_are_held(spark):
    rows = [(0, 1, [1e30, 1.0]), (1, 1, [1e30, 0.0]), (2, 2, [1e5, 0.0]), (3, 2, [-1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert all(r[4] == (1 << 63) - 1 for r in mined(df))
