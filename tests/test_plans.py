import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens import cli
from stratalens.plans import power, scoring


def test_retries_give_up_or_succeed():
    waits, calls = [], []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise scoring.Transient("busy")
        return "ok"

    assert scoring.with_retries(flaky, "x", sleep=waits.append) == ("ok", 2, None) and 1 <= waits[0] < 2 <= waits[1] < 3

    def never(p):
        raise scoring.Transient("down")

    assert scoring.with_retries(never, "x", sleep=lambda s: None) == (None, 3, "down")
    with pytest.raises(ValueError):
        scoring.with_retries(lambda p: (_ for _ in ()).throw(ValueError()), "x")


def test_scored_records_and_rescue(spark):
    units = spark.createDataFrame([(i, "bad" if i == 7 else f"t{i}") for i in range(70)], "unit_id long, prompt string")
    each = scoring.score_each(units, lambda: lambda p: f"r:{p}", "j", "c").collect()
    assert len(each) == 70 and all(r["raw_response"].startswith("r:") and r["retry_count"] == 0 for r in each)

    def make():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError("cannot")
            return [float(len(t)) for t in texts]

        return model

    rows = {r["unit_id"]: r for r in scoring.score_batches(units.coalesce(1), make, "prompt").collect()}
    assert rows["7"]["score"] is None and rows["7"]["status"] == "error: RuntimeError"
    assert rows["8"]["status"] == "ok_rescued" and rows["69"]["status"] == "ok"


def test_resumption_keeps_whole_batches(spark):
    ids = [str(1000 - 3 * i) for i in range(100)]
    targets = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "at long, unit_id string").repartition(5)
    log = lambda rows: spark.createDataFrame([(10 * k, x) for k, x in enumerate(rows)], "line long, unit_id string").repartition(3)
    resume = lambda rows: scoring.resumable(log(rows), targets, "line", "unit_id", "at", span=16)
    assert {r["unit_id"] for r in resume(ids[:70]).collect()} == set(ids[:64])
    assert resume(ids[:64] + ["torn", "batch"]).count() == 64  # what is past the last whole batch goes
    assert resume([]).count() == 0 and resume(ids[:31]).count() == 0
    for wrong in ([*ids[:40], "other", *ids[41:70]], [*ids[:20], *ids[21:70]], [*ids[:30], ids[31], ids[30], *ids[32:70]], [*ids[:5], ids[4], *ids[5:70]], [*ids, *(f"x{i}" for i in range(40))]):
        with pytest.raises(ValueError):
            resume(wrong)


def test_power_grows_with_the_shift(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(1, 7)), int(rng.random() < 0.4), int(rng.integers(0, 4))) for i in range(1500)]
    df = spark.createDataFrame(rows, "unit_id long, s_raw double, a int, z int")
    got = {(r["size"], r["share"]): r["power"] for r in power.power(df, [800], [0.0, 0.9], 20, 99, 5).collect()}
    assert got[800, 0.0] <= 0.3 and got[800, 0.9] >= got[800, 0.0]


def test_kolmogorov_distance(spark):
    even = spark.createDataFrame([((i + 0.5) / 100,) for i in range(100)], "p_value double")
    assert power.kolmogorov(even).first()["ks"] == pytest.approx(0.005)


def test_cli_runs_a_query(spark, tmp_path, capsys):
    cli.main(["query", "a1_contingency_cube", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    assert cli.diagnostics(spark, 10_000).count() == 6


def test_power_takes_pools_of_any_size(spark):
    counts = spark.range(3).selectExpr("id AS unit_id", "CAST(id AS double) AS s_raw", "CAST(id % 2 AS int) AS a", "0 AS z")
    many = counts.crossJoin(spark.range(1000).withColumnRenamed("id", "k")).drop("k")
    (row,) = power.power(many, [200], [0.0], 3, 19, 5).collect()
    assert row["replicates"] == 3 and row["mean_usable_strata"] == 1 and 40 < row["mean_n_a1"] < 95


def test_numbering_without_one_window(spark):
    from stratalens.operators import ranks

    df = spark.range(500).selectExpr("id * 37 % 500 AS v", "sha2(CAST(id AS string), 256) AS k")
    rows = ranks.in_hash_order(ranks.numbered(df, "v", "place"), "k", "r").collect()
    assert all(r["place"] == r["v"] + 1 for r in rows)
    assert [r["k"] for r in sorted(rows, key=lambda r: r["r"])] == sorted(r["k"] for r in rows) and sorted(r["r"] for r in rows) == list(range(1, 501))


def test_prediction_check_over_material_cells(spark):
    from stratalens.operators import gaps

    df = spark.createDataFrame([(0.2, 0.21), (-0.1, -0.12), (0.01, 5.0)], "p double, q double")
    row = gaps.prediction_check(df, "p", "q").first()
    assert (row["cells"], row["material_cells"], row["holds"]) == (3, 2, True) and abs(row["median_change"] - 0.125) < 1e-9
    assert gaps.prediction_check(df.limit(0), "p", "q").first()["median_change"] is None


def test_report_again_from_saved_rates(spark, tmp_path):
    import json

    rate = lambda scenario, n, method, x: {"scenario": scenario, "n": n, "method": method, "null_status": "true", "rejection_rate": x, "ci_low": x / 2, "ci_high": 2 * x}
    rows = [rate("b_null", 500, "conditional_g2", 0.04), rate("b_null", 2000, "conditional_g2", 0.06), rate("b_null", 2000, "mean_disparity", 0.05), rate("a_shift", 2000, "regression_lrt", 0.5)]
    (tmp_path / "rates.json").write_text(json.dumps(rows))
    cli.main(["tables", "--out", str(tmp_path)])
    text = (tmp_path / "table.md").read_text()
    lines = [[x.strip() for x in line.split("|")[1:-1]] for line in text.splitlines() if line.startswith("| ")]
    assert lines[0][:2] == ["scenario", "null_status"] and lines[1][0] == "a_shift" and lines[2][2] == "0.060 [0.030, 0.120]"
    assert ["b_null", "500", "0.040", "-", "-"] in lines and "n = 2000" in text
    assert r"b\_null" in (tmp_path / "table.tex").read_text()
    with pytest.raises(SystemExit):
        cli.main(["tables", "--out", str(tmp_path / "none")])
