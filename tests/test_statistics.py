import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.functions import distributions
from stratalens.operators import alignment, binning, frame, gaps, lineage, multiplicity, sampling, statistics, strata
from stratalens.plans import experiment, logistic, permutation, scenarios


def sample(spark, s, a, z, bins="identity"):
    df = spark.createDataFrame([(i, float(x), int(y), int(k)) for i, (x, y, k) in enumerate(zip(s, a, z, strict=True))], "unit_id long, s_raw double, a int, z int")
    return binning.discretize(df, bins) if bins else df


@pytest.mark.parametrize(
    ("s", "a", "z", "g2"),
    [([0, 0, 1, 1], [0, 1, 0, 1], [0] * 4, 0.0), ([0, 0, 1, 1], [0, 0, 1, 1], [0] * 4, 8 * math.log(2)), ([0, 0, 1, 1], [0, 1, 0, 1], [0, 0, 1, 1], 0.0)],
)
def test_g2_closed_forms(spark, s, a, z, g2):
    df = sample(spark, s, a, z)
    assert statistics.conditional_g2(df).first()["conditional_g2"] == pytest.approx(g2, abs=1e-12)
    assert statistics.conditional_mi(df).first()["conditional_mi"] == pytest.approx(g2 / 8, abs=1e-12)


def test_disparity_and_lrt_closed_forms(spark):
    one = lambda f, *x: f(sample(spark, *x, bins=None)).first()[0]
    assert one(statistics.mean_disparity, [0, 2, 5, 5], [0, 1, 0, 1], [0, 0, 1, 1]) == pytest.approx(1.0)
    assert one(statistics.mean_disparity, [-2, 2, -1, 1], [0, 0, 1, 1], [0] * 4) == pytest.approx(0.0)
    assert one(statistics.regression_lrt, [-2, 2, -1, 1], [0, 0, 1, 1], [0] * 4) == pytest.approx(0.0)
    assert one(statistics.regression_lrt, [0, 1, 2, 3], [0, 0, 1, 1], [0] * 4) == pytest.approx(4 * math.log(5))


def test_sparse_cells_are_finite(spark):
    df = sample(spark, range(5), [0, 0, 1, 0, 1], [0, 0, 0, 1, 2])
    for r in statistics.observed(df, list(statistics.STATISTICS)).collect():
        assert math.isfinite(r["observed"])


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        statistics.statistic("nothing")
    with pytest.raises(ValueError):
        binning.discretize(spark.range(1), "nothing")
    with pytest.raises(KeyError):
        scenarios.scenario("nothing")


def test_ties_collapse_and_bins_are_dense(spark):
    df = sample(spark, [3] * 9 + [5], [0, 1] * 5, [0] * 10, bins=None)
    assert {r["s_bin"] for r in binning.quantile_bins(df, 8).collect()} <= {0, 1}
    got = {r["unit_id"]: r["s_bin"] for r in binning.identity_bins(sample(spark, [1, 3, 5, 3], [0] * 4, [0] * 4, bins=None)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1}


def test_binning_never_sees_the_attribute(spark):
    with pytest.raises(ValueError):
        frame.blind(sample(spark, [1], [0], [0], bins=None))


def test_informative_strata(spark):
    df = sample(spark, [1] * 5, [0, 1, 0, 1, 1], [0, 0, 1, 2, 2], bins=None)
    assert strata.support(strata.stratum_table(df)).first().asDict() == {"n": 5, "n_a1": 3, "n_strata": 3, "n_informative": 1, "retained": 2, "retained_a1": 1}


def test_validation(spark):
    good = sample(spark, [1, 2], [0, 1], [0, 0], bins=None)
    assert frame.validate(good, {"a": 2}).count() == 2
    for bad in (good.withColumn("s_raw", F.lit(float("nan"))), good.withColumn("a", F.lit(-1)), good.limit(0), good.withColumn("unit_id", F.lit(1))):
        with pytest.raises(ValueError):
            frame.validate(bad)
    with pytest.raises(ValueError):
        frame.validate(good, {"a": 1})


@pytest.mark.parametrize(("x", "level", "coarse", "half", "high"), [("0", 0, 0, 0, 0), ("0.25", 1, 1, 0, None), ("0.2500001", 2, 1, 0, None), ("0.5", 3, 2, 1, None), ("0.75", 4, 2, 1, None), ("0.8", 4, 2, 1, 1), ("1.0", 4, 2, 1, 1)])
def test_semantic_bins(spark, x, level, coarse, half, high):
    row = spark.createDataFrame([(x,)], "x string").select(frame.level_bin("x"), frame.coarse_bin("x"), frame.at_least_half("x"), frame.high_confidence("x")).first()
    assert tuple(row) == (level, coarse, half, high)


@pytest.mark.parametrize("engine", ["portable", "grouped", "chunked"])
def test_permutations_keep_strata_and_are_uniform(spark, engine):
    rng = np.random.default_rng(3)
    n = 120
    df = sample(spark, rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 3, n), bins=None)
    df = binning.quantile_bins(df, 4)
    want = {(r["z"], r["a"]): r["count"] for r in df.groupBy("z", "a").count().collect()}
    if engine == "portable":
        cube = permutation.permuted(df, 7, 5).groupBy("draw", "z", "a").agg(F.count("*").alias("n"))
    else:
        cube = permutation.grouped_cells(df, 7, 5, block=3, chunk=10 if engine == "chunked" else 10_000).groupBy("draw", "z", "a").agg(F.sum("n").alias("n"))
    rows = cube.filter("draw > 0").collect()
    assert len(rows) == 7 * len(want) and all(want[r["z"], r["a"]] == r["n"] for r in rows)


def test_engines_agree_on_the_data_and_on_p(spark):
    rng = np.random.default_rng(4)
    n = 300
    z, a = rng.integers(0, 4, n), rng.integers(0, 2, n)
    df = binning.quantile_bins(sample(spark, z + 0.25 * a + rng.normal(size=n), a, z, bins=None), 4)
    real = {r["statistic"]: r["observed"] for r in statistics.observed(df, ["conditional_g2", "mean_disparity", "regression_lrt"]).collect()}
    ps = []
    for chunk in (10_000, 20):
        got = {r["statistic"]: r for r in permutation.grouped_test(df.withColumn("a", F.col("a")), 499, 1).collect()} if chunk > 1000 else {
            r["statistic"]: r for r in permutation.p_values(permutation.grouped_null(df, 499, 1, chunk=chunk).filter("draw > 0"), spark.createDataFrame(list(real.items()), "statistic string, observed double"), 499).collect()
        }
        for name, value in real.items():
            assert got[name]["observed"] == pytest.approx(value, abs=1e-8)
            assert 1 / 500 <= got[name]["p_value"] <= 1
        ps.append([got[name]["p_value"] for name in sorted(real)])
    assert np.abs(np.subtract(*ps)).max() < 0.12
    table = permutation.p_values(permutation.table_null(df, 499, 1).filter("draw > 0").withColumn("statistic", F.lit("conditional_g2")), spark.createDataFrame([("conditional_g2", real["conditional_g2"])], "statistic string, observed double"), 499).first()
    assert abs(table["p_value"] - ps[0][0]) < 0.12


def test_p_value_counts_near_ties(spark):
    null = spark.createDataFrame([("t", 1.0), ("t", 1.0 - 1e-12), ("t", 0.5)], "statistic string, value double")
    real = spark.createDataFrame([("t", 1.0)], "statistic string, observed double")
    assert permutation.p_values(null, real, 3).first()["p_value"] == pytest.approx(3 / 4)


def test_holm_and_wilson(spark):
    p = [0.001] * 3 + [0.02, 0.04, 0.5]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, position int, p double")
    got = [r["p_holm"] for r in multiplicity.holm(df, ["family"]).orderBy("position").collect()]
    want, top = [], 0.0
    for i, x in enumerate(p):
        top = max(top, min(1.0, (len(p) - i) * x))
        want.append(top)
    assert got == pytest.approx(want)
    rows = spark.createDataFrame([(56, 1000), (0, 10), (10, 10), (0, 0)], "k long, n long")
    low, high = multiplicity.wilson("k", "n")
    bounds = [tuple(r) for r in rows.select(low, high).collect()]
    assert bounds[0] == pytest.approx((0.0433748, 0.0720233), abs=1e-6)
    assert bounds[1][0] == 0.0 and bounds[2][1] == 1.0 and bounds[3] == (None, None)


def test_alpha_is_inclusive(spark):
    df = spark.createDataFrame([("m", p) for p in (0.01, 0.05, 0.0500001, 0.2, 0.9)], "method string, p double")
    assert multiplicity.rejection_rates(df, ["method"]).first()["n_rejections"] == 2


def test_special_functions(spark):
    d = distributions
    row = spark.range(1).select(d.fisher_two_sided(3, 1, 1, 3), d.t_two_sided(2.0, 10), d.chi2_sf(3.841459, 1), d.f_sf(4.9646, 1, 10), d.mann_whitney_two_sided(50, 10, 10, 0)).first()
    assert row[:] == (pytest.approx(0.4857142857), pytest.approx(0.0733880, abs=1e-6), pytest.approx(0.05, abs=1e-6), pytest.approx(0.05, abs=1e-4), pytest.approx(1.0, abs=0.1))


def test_distributions_against_closed_forms(spark):
    d, exact = distributions, []
    cases = []
    for t in (1e-6, 0.01, 0.7, 3.0, 90.0):
        cases.append(d.t_two_sided(t, 1))
        exact.append(2 / math.pi * math.atan2(1, t))
        cases.append(d.t_two_sided(t, 2))
        exact.append(2 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t)))
    for f in (0.0, 0.02, 1.0, 4.0, 60.0):
        for den in (1.0, 9.0, 4000.0, 1e6, 1e8):
            cases.append(d.f_sf(f, 2, den))
            exact.append(math.exp(-den / 2 * math.log1p(2 * f / den)))
    for x in (0.0, 0.3, 9.0, 200.0):
        cases += [d.chi2_sf(x, 2), d.chi2_sf(x, 4), d.normal_two_sided(math.sqrt(x))]
        exact += [math.exp(-x / 2), math.exp(-x / 2) * (1 + x / 2), math.erfc(math.sqrt(x / 2))]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert all(g == pytest.approx(e, rel=1e-9, abs=1e-15) for g, e in zip(got, exact, strict=True))


def test_distributions_of_odd_arguments(spark):
    d = distributions
    rows = spark.createDataFrame([(None, 3.0), (1.0, None), (float("nan"), 3.0), (1.0, 0.0), (float("inf"), 3.0), (1.0, 1e300)], "x double, k double")
    got = rows.select(d.t_two_sided("x", "k").alias("t"), d.chi2_sf("x", F.least("k", F.lit(50.0))).alias("c"), d.f_sf("x", "k", "k").alias("f")).collect()
    assert [r["t"] for r in got[:5]] == [None] * 5 and got[5]["t"] == pytest.approx(0.3173105, abs=1e-6)
    assert [r["c"] is None for r in got] == [True, False, True, True, True, False] and got[5]["f"] == pytest.approx(0.5, abs=1e-3)


def test_barrier_follows_columns_through_a_plan(spark):
    people = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.7)], "id long, gender string, score double")
    other = spark.createDataFrame([(1, 3)], "id long, level int")
    renamed = people.withColumnRenamed("gender", "g")
    derived = people.select("id", F.when(F.col("gender") == "x", 1).otherwise(0).alias("flag")).select("id", (F.col("flag") * 2).alias("double_flag"))
    joined = other.join(people.select("id", F.upper("gender").alias("u")), "id")
    counted = people.groupBy("id").agg(F.max("gender").alias("m"))
    both = people.select("id", F.lit("c").alias("c")).unionByName(people.select("id", F.col("gender").alias("c")))
    window = people.select("id", F.first("gender").over(Window.partitionBy("id").orderBy("score")).alias("w"))
    opaque = people.mapInPandas(lambda it: it, "id long, hidden string, score double")
    listed = people.select("id", F.explode(F.array("gender")).alias("e"))
    for bad in (renamed, derived, joined, counted, both, window, opaque, listed):
        with pytest.raises(ValueError):
            frame.blind(bad)
    assert lineage.lineage(derived)["double_flag"] == {"gender"}
    for good in (people.drop("gender"), other.join(people.select("id", "score"), "id"), people.filter("gender = 'x'").select("id", "score"), derived.select("id")):
        assert frame.blind(good) is good
    with pytest.raises(ValueError):
        lineage.barrier(people.filter("gender = 'x'").select("id"), frame.FORBIDDEN, conditions=True)
    assert lineage.lineage(people.groupBy("gender").count(), conditions=True)["count"] == {"gender"}


def test_allocation_and_sample(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 3)], "z string, n long")
    got = {r["z"]: r["allocated"] for r in sampling.hamilton(sizes, 11).collect()}
    assert sum(got.values()) == 11 and got["c"] <= 3
    df = spark.range(1000).select(F.col("id").alias("unit_id"), (F.col("id") % 7).alias("z"))
    one = sampling.stratified_sample(df, 100, 3)
    ids = {r["unit_id"] for r in one.collect()}
    assert len(ids) == 100 and ids == {r["unit_id"] for r in sampling.stratified_sample(df.repartition(9), 100, 3).collect()}


def test_gaps_on_small_tables(spark):
    df = sample(spark, [1, 3, 5, 7], [0, 1, 0, 1], [0, 0, 1, 1], bins=None)
    assert gaps.mean_gap(df).first()["gap"] == pytest.approx(2.0)
    alone = sample(spark, [1, 3], [0, 0], [0, 0], bins=None)
    assert gaps.mean_gap(alone).first()["gap"] is None
    d = gaps.decomposition(df.withColumn("w", F.col("unit_id") % 2), ["z"], ["z", "w"]).first()
    assert d["augmented_gap"] is None and d["n_common"] == 0


def test_kappa_of_perfect_agreement(spark):
    df = spark.createDataFrame([(i % 6 + 1, i % 6 + 1) for i in range(30)], "y int, s int")
    assert alignment.weighted_kappa(df).first()["qwk"] == pytest.approx(1.0)
    assert sum(r["n"] for r in alignment.confusion(df).collect()) == 30
    assert len(alignment.matrix(df).first()["matrix"]) == 6


def test_logistic_matches_a_direct_solution(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * x - 0.4)))).astype(int)
    got = logistic.fit(spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x int, y int"), ["x"], "y")
    assert got["converged"]
    design = np.c_[np.ones(400), x]
    beta = np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design * (mu * (1 - mu))[:, None]).T @ design, design.T @ (y - mu))
    assert got["beta"] == pytest.approx(beta.tolist(), abs=1e-7)


def test_scenarios_have_their_moments():
    rng = np.random.default_rng(0)
    s, a, z = scenarios.mean_dependence(60_000, rng)
    gap = np.mean([s[(z == q) & (a == 1)].mean() - s[(z == q) & (a == 0)].mean() for q in range(5)])
    assert gap == pytest.approx(0.30, abs=0.05)
    s, a, z = scenarios.variance_only(60_000, rng)
    assert s[(z == 2) & (a == 1)].std() == pytest.approx(1.6, abs=0.06)
    s, a, z = scenarios.shape_only(60_000, rng)
    assert s[(z == 2) & (a == 1)].var() == pytest.approx(1.0, abs=0.06)


def test_experiment_controls_error_and_has_power(spark):
    config = experiment.Config(scenarios=("conditional_null", "variance_only"), sizes=(500,), replicates=60, permutations=99)
    rows = experiment.run(spark, config).cache()
    rates = {(r["scenario"], r["method"]): r["rejection_rate"] for r in experiment.rates(rows).collect()}
    assert rows.count() == 2 * 60 * 3
    assert rates["conditional_null", "conditional_g2"] <= 0.05 + 4 * math.sqrt(0.05 * 0.95 / 60)
    assert rates["variance_only", "conditional_g2"] > 0.6 > rates["variance_only", "mean_disparity"] + 0.2
    again = experiment.run(spark, config).repartition(3)
    assert rows.exceptAll(again).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_ranks_and_quantiles_equal_numpy(spark, seed):
    from stratalens.operators.ranks import quantiles, with_below

    rng = np.random.default_rng(seed)
    x = rng.integers(0, [5, 300, 10**6][seed], 500).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    counts = df.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("k"))
    assert {r["v"]: r["below"] for r in with_below(counts, "v", "k", "below").collect()} == {v: int((x < v).sum()) for v in np.unique(x)}
    p = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    assert quantiles(df, "v", p, "q").first()["q"] == pytest.approx(np.quantile(x, p).tolist())
    assert quantiles(df.limit(0), "v", p, "q").first()["q"] is None


def units_of(spark, rows):
    return spark.createDataFrame([(i, float(s), s_bin, a, z) for i, (s, s_bin, a, z) in enumerate(rows)], "unit_id long, s_raw double, s_bin int, a int, z int")


def test_statistics_of_cells_equal_those_of_units(spark):
    from stratalens.operators import cell_statistics, gaps

    rng = np.random.default_rng(8)
    df = units_of(spark, [(int(s), int(s), int(rng.random() < 0.4), int(rng.integers(0, 5))) for s in rng.integers(1, 7, 200)])
    got = {r["statistic"]: r["observed"] for r in cell_statistics.long(cell_statistics.cell_frame(df), list(cell_statistics.CELL_STATISTICS)).collect()}
    for r in statistics.observed(df, ["conditional_g2", "conditional_mi", "mean_disparity", "regression_lrt"]).collect():
        assert got[r["statistic"]] == pytest.approx(r["observed"], abs=1e-8)
    assert got["weighted_gap"] == pytest.approx(gaps.mean_gap(df).first()["gap"])
    assert got["variance_gap"] == pytest.approx(gaps.diagnostics(df).first()["variance_diff"])


def test_statistics_of_cells_without_rows_or_contrast(spark):
    from stratalens.operators import cell_statistics

    df = units_of(spark, [(1, 0, 0, 0), (5, 0, 0, 0), (2, 0, 1, 1)])
    names = ["weighted_gap", "variance_gap", "mean_disparity"]
    row = cell_statistics.wide(cell_statistics.cell_frame(df), names).first()
    assert row["weighted_gap"] is None and row["variance_gap"] is None and row["mean_disparity"] == 0
    empty = cell_statistics.cell_frame(df.limit(0))
    assert cell_statistics.wide(empty, names).first().asDict() == dict.fromkeys(names)
    assert cell_statistics.wide(cell_statistics.cell_frame(df.limit(0), ["z"]), names, ["z"]).count() == 0
    with pytest.raises(ValueError):
        cell_statistics.wide(empty, ["nothing"])
    with pytest.raises(ValueError):
        cell_statistics.register_cells("not a name", cell_statistics.CELL_STATISTICS["mean_disparity"])


def test_a_registered_statistic_runs_in_the_permutation_engine(spark):
    from stratalens.operators import cell_statistics as cs

    # the share of group 1 in the top bin of its stratum, greatest over strata
    top = cs.CellStatistic(
        lambda get: F.max(get("share")),
        lambda get: {"share": F.max(F.when(F.col("a") == 1, get("top") / F.col("n")))},
        lambda get: {"top": F.sum(F.when(F.col("s_bin") == 5, F.col("n")).otherwise(0))},
    )
    cs.register_cells("top_share", top)
    try:
        rng = np.random.default_rng(2)
        rows = [(s, int(s), int(rng.random() < (0.9 if s == 5 and k == 0 else 0.3)), k) for k in (0, 1) for s in rng.integers(0, 6, 120)]
        df = units_of(spark, rows)
        want = max(np.mean([s == 5 for s, _, a, z in rows if a == 1 and z == k]) for k in (0, 1))
        got = {r["statistic"]: r for r in permutation.grouped_test(df, 199, 3, ["top_share", "conditional_g2"]).collect()}
        assert got["top_share"]["observed"] == pytest.approx(want) and got["top_share"]["p_value"] < 0.02
        assert got["conditional_g2"]["observed"] == pytest.approx(statistics.conditional_g2(df).first()["conditional_g2"])
    finally:
        del cs.CELL_STATISTICS["top_share"]


def test_grouped_paired_test_against_all_permutations(spark):
    from itertools import combinations, product

    strata = {0: [(1.0, 1), (2.0, 1), (0.5, 0), (-1.0, 0), (0.0, 0)], 1: [(3.0, 1), (1.0, 0), (0.0, 0), (2.5, 1)], 2: [(9.0, 1)]}
    rows = [(s, 0, a, z) for z, units in strata.items() for s, a in units]

    def gaps(units):
        s, k = np.array([x for x, _ in units]), sum(a for _, a in units)
        return [s[list(c)].mean() - np.delete(s, list(c)).mean() for c in combinations(range(len(s)), k)]

    null = [(5 * x + 4 * y) / 9 for x, y in product(gaps(strata[0]), gaps(strata[1]))]
    real = (5 * (1.5 + 0.5 / 3) + 4 * (2.75 - 0.5)) / 9
    exact = np.mean(np.abs(null) >= abs(real) - 1e-12)
    for chunk in (8192, 2):
        found = permutation.grouped_null(units_of(spark, rows), 4000, 5, chunk=chunk, names=["weighted_gap"]).filter("draw > 0").toPandas()["value"]
        assert abs(found.mean() - np.mean(null)) < 0.1 and abs(found.std() / np.std(null) - 1) < 0.08
        assert abs((found.abs() >= abs(real) - 1e-9).mean() - exact) < 0.02
    row = permutation.grouped_paired_test(units_of(spark, rows), 999, 5).first()
    assert row["observed"] == pytest.approx(real) and abs(row["p_value"] - exact) < 0.04
    slow = permutation.paired_test(units_of(spark, rows), 199, 5).first()
    assert slow["observed"] == pytest.approx(real) and abs(slow["p_value"] - exact) < 0.1
