"""Draws of any size, the split tree, attribute families, count bootstraps: exact small cases, moments, uniformity."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import ranks
from stratalens.plans import draws, family, permutation, resampling


@pytest.mark.parametrize("good, bad, n", [(10**12, 3 * 10**12, 10**11), (2 * 10**9, 10, 10**9), (5 * 10**9, 5 * 10**9, 20), (10**15, 10**15, 10**15), (10**12, 10**6, 10**12 // 2)])
def test_moments_of_large_hypergeometric_draws(good, bad, n):
    x = draws.hypergeometric(draws.stream(3, good, bad), np.full(40_000, good), bad, n)
    total = good + bad
    mean, var = n * good / total, n * (good / total) * (bad / total) * ((total - n) / (total - 1))
    assert x.min() >= max(0, n - bad) and x.max() <= min(good, n)
    off = (x - int(mean)).astype(float)
    assert abs(off.mean() - (mean - int(mean))) < 5 * math.sqrt(var / 40_000) + 1e-9
    assert abs(off.var() / var - 1) < 0.05


def test_rejection_draws_follow_the_exact_law():
    x = draws._ratio_of_uniforms(draws.stream(1, "small"), np.full(200_000, 7.0), np.full(200_000, 9.0), np.full(200_000, 6.0))
    got = np.bincount(x.astype(int), minlength=7) / 200_000
    want = [math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6) for k in range(7)]
    assert np.abs(got - want).max() < 0.005
    assert draws.hypergeometric(draws.stream(1, "edge"), [0, 5 * 10**9, 3, 7], [4, 0, 0, 5 * 10**9], [2, 9, 3, 0]).tolist() == [0, 9, 3, 0]


def test_tables_have_their_margins_and_the_law_of_a_permutation():
    rows, columns = np.array([2, 1, 2]), np.array([3, 2])
    t = draws.tables(draws.stream(2, "t"), rows, np.tile(columns, (60_000, 1)))
    assert (t.sum(2) == rows).all() and (t.sum(1) == columns).all()
    got = Counter(map(tuple, t[:, :, 0].tolist()))
    of = np.repeat([0, 1, 2], rows)
    want = Counter(tuple(np.bincount(of[list(c)], minlength=3)) for c in itertools.combinations(range(5), 3))
    assert {k for k in got} == {tuple(map(int, k)) for k in want}
    assert all(abs(got[tuple(map(int, k))] / 60_000 - n / 10) < 0.01 for k, n in want.items())


def test_all_leaves_agree_and_deal_uniformly():
    sizes = [3, 2, 0, 4]  # of four leaves
    paths = [[(5, 4), (3, 2)], [(5, 4), (3, 2)], [(5, 4), (0, 4)], [(5, 4), (0, 4)]]
    labels = np.tile([5, 4], (20_000, 1))
    dealt = np.stack([draws.walk(9, ("z", 0), p, i, labels) for i, p in enumerate(paths)])
    assert (dealt.sum(0) == labels).all() and all((d.sum(1) == n).all() for d, n in zip(dealt, sizes, strict=True))
    for i, n in enumerate(sizes):
        mean, var = n * 5 / 9, n * (5 / 9) * (4 / 9) * (9 - n) / 8
        assert abs(dealt[i, :, 0].mean() - mean) < 0.03 and abs(dealt[i, :, 0].var() - var) < 0.05
    taken = np.stack([draws.resample(9, ("z",), p, i, 9, 20_000) for i, p in enumerate(paths)])
    assert (taken.sum(0) == 9).all() and (taken[2] == 0).all()
    assert abs(taken[0].mean() - 3) < 0.05 and abs(taken[0].var() - 2) < 0.1


def units(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.integers(1, 7)), int(rng.random() < 0.4), int(rng.integers(0, 3) == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "unit_id long, s_raw double, a int, z int").withColumn("s_bin", F.col("s_raw").cast("int"))


def test_leaves_know_their_path(spark):
    placed, paths = permutation.leaves(units(spark), 50)
    sizes = Counter((r["z"], r["leaf"]) for r in placed.collect())
    rows = paths.collect()
    assert {(r["z"], r["leaf"]) for r in rows} == set(sizes) and sum(sizes.values()) == 600 and len(sizes) > 6
    for r in rows:
        depth = len(r["path"])
        for level, step in enumerate(r["path"]):
            inside = [(leaf >> (depth - level - 1), n) for (z, leaf), n in sizes.items() if z == r["z"] and leaf >> (depth - level) == r["leaf"] >> (depth - level)]
            assert step["l"] == sum(n for c, n in inside if c % 2 == 0) and step["r"] == sum(n for c, n in inside if c % 2)


def test_split_strata_give_the_null_of_whole_ones(spark):
    df = units(spark)
    whole, split = (permutation.grouped_cells(df, 400, 5, chunk=c).toPandas() for c in (100_000, 40))
    for cube in (whole, split):
        n = cube.groupby(["draw", "z", "a"])["n"].sum().unstack("draw")
        assert (n.nunique(axis=1) == 1).all()  # margins are kept in each draw
    real = [c[c["draw"] == 0].sort_values(["z", "s_bin", "a"])["n"].tolist() for c in (whole, split)]
    assert real[0] == real[1]
    one = lambda c: c[(c["draw"] > 0) & (c["z"] == 0) & (c["s_bin"] == 2) & (c["a"] == 1)]["n"]
    assert abs(one(whole).mean() - one(split).mean()) < 1.2 and 0.7 < one(split).std() / one(whole).std() < 1.4


def test_table_null_takes_counts_past_any_bound(spark):
    rows = [(0, 0, 0, 4 * 10**12), (0, 1, 0, 10**12), (0, 0, 1, 2 * 10**12), (0, 1, 1, 3 * 10**12)]
    cube = spark.createDataFrame(rows, "z int, s_bin int, a int, n long")
    values = [r["value"] for r in permutation.cells_null(cube, 800, 3).orderBy("draw").collect()]
    assert values[0] > 1e11 and abs(np.mean(values[1:]) - 1) < 0.2 and abs(np.var(values[1:]) - 2) < 1  # chi-square of one degree


def test_family_tests_each_attribute_as_if_alone(spark):
    df = units(spark)
    attributes = {"own": F.col("a"), "score": (F.col("s_raw") > 3).cast("int"), "some": F.when(F.col("unit_id") % 3 == 0, -1).otherwise(F.col("a"))}
    rows = {r["attribute"]: r for r in family.family_test(df, attributes, 199, 11).collect()}
    assert rows["score"]["p_value"] == 1 / 200 and rows["score"]["reject"] and rows["some"]["n"] == 400
    alone = family.family_test(df, {"some": attributes["some"]}, 199, 11).first()
    assert all(alone[c] == rows["some"][c] for c in ("conditional_g2", "p_value", "gap", "n_informative"))
    ps = sorted((r["p_value"], a) for a, r in rows.items())
    assert rows[ps[0][1]]["p_holm"] == pytest.approx(min(1, 3 * ps[0][0]))


def test_sweep_is_uniform_on_null_data_and_not_on_broken_data(spark):
    cube = family.family_cells(units(spark, 2000), {"own": F.col("a")})
    sweep = family.control_sweep(cube, 200, 499, 8).cache()
    (row,) = family.sweep_summary(sweep, 499).collect()
    assert row["tests"] == 200 and row["uniform"]
    broken = sweep.withColumn("p_value", F.col("p_value") * 0.7)
    assert not family.sweep_summary(broken, 499).first()["uniform"]


def test_count_bootstrap_has_the_moments_of_the_unit_form(spark):
    df = units(spark, 300)
    unit = resampling.stratified_bootstrap(df, 600, "x").toPandas()["gap"]
    for chunk in (8192, 2):
        count = resampling.count_bootstrap(df, 600, 7, chunk=chunk).toPandas()["gap"]
        assert len(count) == 600 and abs(count.mean() - unit.mean()) < 0.05 and 0.85 < count.std() / unit.std() < 1.18
    plan = resampling.count_bootstrap(df, 600, 7)._jdf.queryExecution().analyzed().toString()
    assert plan.count("explode(") == plan.count("explode(sequence(0, depth")  # leaves' levels alone, never units or resamples


def test_count_cluster_bootstrap(spark):
    clusters = spark.createDataFrame([(i, float(i % 7), 1 + i % 3) for i in range(120)], "cluster long, d_sum double, n long")
    one, two = (f.toPandas()["mean"] for f in (resampling.cluster_bootstrap(clusters, 500, "c"), resampling.count_cluster_bootstrap(clusters, 500, 5)))
    assert abs(one.mean() - two.mean()) < 0.03 and 0.85 < two.std() / one.std() < 1.18


def test_ranks_and_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(["x", "y", "hot"][min(2, int(rng.integers(0, 6)))], float(rng.integers(0, 40)) if rng.random() < 0.9 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, i long").cache()
    import pandas as pd

    pdf = df.toPandas()
    want = pdf.groupby("g")["v"].rank()
    got = {r["i"]: r["r"] for r in ranks.average_ranks(df, "v", "r", ["g"]).collect()}
    assert got == {int(i): w for i, w in zip(pdf["i"], want, strict=True) if not pd.isna(w)}
    q = {r["g"]: r["q"] for r in ranks.quantiles(df, "v", [0, 0.3, 0.5, 1], "q", ["g"]).collect()}
    assert all(np.allclose(q[g], np.quantile(p["v"].dropna(), [0, 0.3, 0.5, 1])) for g, p in pdf.groupby("g"))
    keyed = df.withColumn("k", F.sha2(F.col("i").cast("string"), 256))
    placed = ranks.in_hash_order(keyed, "k", "p", ["g"], rows=900_000).toPandas()
    assert (placed["p"] == placed.groupby("g")["k"].rank().astype(int)).all()
