"""Queries on what larger tables hold: repeated values, rows without a group, groups cut into ranges."""

import duckdb
import pytest
from conftest import canonical
from pyspark.sql import functions as F

from stratalens import catalog
from stratalens.operators import binning
from stratalens.plans import hashed, permutation, resampling


def agrees(spark, name, folder, tables):
    """The query on a folder's tables gives the rows of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df, expected = catalog.queries()[name](spark, str(folder)), con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert canonical(df.collect(), df.columns) == canonical(expected.fetchall(), expected.columns)


def test_edges_between_equal_values_are_that_value(spark):
    rows = [(k, k / 100) for k in range(1, 1000) for _ in range(5)]
    out = binning.within_groups(spark.createDataFrame(rows, "g int, v double"), "v", "g")
    assert out.filter("tertile > 0 OR half > 0").count() == 0


def test_within_group_bins_of_copies_and_nulls_match_sql(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 300")
    copies = events.crossJoin(spark.range(6).withColumnRenamed("id", "copy"))
    user = F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 9)
    value = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    copies.withColumns({"event_id": F.col("event_id") + 1000 * F.col("copy"), "user_id": user, "value": value}).drop("copy").write.parquet(str(tmp_path / "events.parquet"))
    agrees(spark, "w12_within_group_bins", tmp_path, ["events"])


def test_summary_holds_no_column_in_a_task(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    copies = orders.crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    copies.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") + F.col("copy") * 0.01)).drop("copy").write.parquet(str(tmp_path / "orders.parquet"))
    agrees(spark, "a32_summary", tmp_path, ["orders"])
    plan = catalog.queries()["a32_summary"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "count(distinct" not in plan


def test_permuted_cells_are_the_sums_of_permuted_rows(spark, tmp_path):
    """One job or many, a stratum whole or in ranges: the same draws as the rows of permuted."""
    units = spark.range(700).selectExpr("id * 3 - 50 AS unit_id", "CAST(id % 37 AS double) / 4 AS s_raw", "CAST(id % 4 AS int) AS s_bin", "IF(id % 19 = 0, NULL, CAST(id * id % 7 = 1 AS int)) AS a", "IF(id % 23 = 0, NULL, IF(id % 5 < 4, 'x:y', 'b')) AS z").cache()
    rows = permutation.permuted(units, 5, 17).groupBy("draw", "z", "s_bin", "a").agg(F.count("*").alias("n"), F.sum("s_raw").alias("s_sum"), F.sum(F.col("s_raw") * F.col("s_raw")).alias("s_sq"))
    want = canonical(rows.collect(), rows.columns)
    for more in ({}, {"at_once": 1500}, {"at_once": 1500, "most": 60}, {"most": 300}):
        got = hashed.permuted_cells(units, 5, 17, **more)
        assert canonical(got.select(*rows.columns).collect(), rows.columns) == want


def without_rows(spark, monkeypatch, test):
    """The test's row as it is where units may not be copied for each draw, and by the engine that copies them."""
    units = spark.range(300).selectExpr("id AS unit_id", "CAST(id * 7 % 11 AS double) AS s_raw", "CAST(id % 3 AS int) AS s_bin", "CAST(id % 4 = 0 AS int) AS a", "CAST(id % 2 AS int) AS z")
    with monkeypatch.context() as m:
        m.setattr(permutation, "_cells_will_do", lambda df, names: False)
        slow = test(units)
    monkeypatch.setattr(permutation, "permuted", None)
    fast = test(units)
    assert [r["n_at_least"] for r in fast] == [r["n_at_least"] for r in slow] and all(a["observed"] == pytest.approx(b["observed"]) for a, b in zip(fast, slow, strict=True))


def test_paired_test_copies_no_unit_for_each_draw(spark, monkeypatch):
    without_rows(spark, monkeypatch, lambda units: permutation.paired_test(units, 49, 5).collect())


def test_portable_test_copies_no_unit_for_each_draw(spark, monkeypatch):
    without_rows(spark, monkeypatch, lambda units: permutation.portable_test(units, ["conditional_g2", "mean_disparity"], 49, 5).orderBy("statistic").collect())


def test_hashed_resamples_are_the_units_that_the_hash_names(spark):
    """Blocks of units and ranges of slots change nothing; the sums are those of picks made one by one."""
    import hashlib

    rows = [(z, k, float(k * k % 31)) for z, m in (("a", 23), ("b:c", 57)) for k in range(m)]
    places = spark.createDataFrame(rows, "z string, k long, v double").withColumn("n", F.lit(1.0))
    of = {(z, k): v for z, k, v in rows}
    pick = lambda z, rep, j, m: int((int(hashlib.sha256(f"s:{rep}:{z}:{j}".encode()).hexdigest()[:13], 16) / 2**52) * m)
    want = {(rep, z): (m, sum(of[z, pick(z, rep, j, m)] for j in range(m))) for rep in range(1, 8) for z, m in (("a", 23), ("b:c", 57))}
    for more in ({}, {"units": 8}, {"units": 8, "slots": 10}):
        got = hashed.drawn_sums(places, ["n", "v"], 7, "s", **more)
        assert {(r["rep"], r["z"]): (r["n"], r["v"]) for r in got.collect()} == want


def test_bootstraps_make_no_row_for_each_unit_and_resample(spark):
    """Only numbers of strata and of clusters are multiplied by resamples, never their units."""
    units = spark.range(40).selectExpr("id AS unit_id", "CAST(id AS double) AS s_raw", "CAST(id % 2 AS int) AS a", "'x' AS z")
    clusters = spark.range(40).selectExpr("id AS cluster", "CAST(id AS double) AS d_sum", "id + 1 AS n")
    for df in (resampling.stratified_bootstrap(units, 30, "s"), resampling.cluster_bootstrap(clusters, 30, "s")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 30 and "sha2" not in plan and all("slot" not in line for line in plan.splitlines() if "Generate" in line)


def test_clusters_without_user_match_sql(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 400")
    events.withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 15)).write.parquet(str(tmp_path / "events.parquet"))
    agrees(spark, "x1_cluster_bootstrap", tmp_path, ["events"])
