import json
import time

import pytest
from pyspark.sql import functions as F

from stratalens import report
from stratalens.functions import text
from stratalens.sources import files
from stratalens.sources.store import Busy, Frozen, ScoreStore, classify, verify_prompts
from stratalens.streaming.append import score_stream

ACCEPT = {'{"score": 1}': 1, '{"score": 6}': 6, '  {"score": 4}  ': 4, '{"score":3}': 3}
REFUSE = ["SCORE: 3", '{"score": 7}', '{"score": 0}', "3", '{"score": 3.5}', '{"score": "3"}', '{"score": true}', '{"Score": 3}', '{"score": 3, "why": "x"}', 'The score is {"score": 3}', "", "[3]", '{"score": null}', None]


def test_strict_parser(spark):
    df = spark.createDataFrame([(r,) for r in [*ACCEPT, *REFUSE]], "r string").select("r", text.strict_score("r").alias("s"), text.refusal("r").alias("why"))
    for row in df.collect():
        assert row["s"] == ACCEPT.get(row["r"]) and (row["why"] is None) == (row["r"] in ACCEPT), row


def test_render_and_insert(spark):
    df = spark.createDataFrame([("X {B}", "b")], "a string, b string")
    out = text.render("{A} {B}", [("{A}", F.col("a")), ("{B}", F.col("b"))])
    assert df.select(out).first()[0] == "X b b"
    assert df.select(text.insert_before(F.lit("a M b M"), "M", "+")).first()[0] == "a +M b M"
    assert df.select(text.insert_before(F.lit("abc"), "M", "+")).first()[0] == "abc"


def test_csv_is_verbatim(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,t\n1,"a ""b""\nc"\n02, \n', encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", 'a "b"\nc'), ("02", " ")]
    files.write_csv(spark.createDataFrame(rows, "id string, t string"), str(tmp_path / "out"), ["t", "id"])
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()) == sorted([('a "b"\nc', "1"), (" ", "02")])


def test_verified_scan(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_text("a\n1\n")
    sha = files.checksums(spark, path).first()["sha256"]
    df = files.read_csv(spark, path)
    assert files.verified(df, spark, path, sha, 1).count() == 1
    for bad in (("0" * 64, 1), (sha, 2)):
        with pytest.raises(ValueError):
            files.verified(df, spark, path, *bad)


def test_covered_join_refuses_gaps(spark):
    a, b = spark.range(3), spark.range(2)
    assert files.covered(b, a, "id").count() == 2
    with pytest.raises(ValueError):
        files.covered(a, b, "id")


def test_store_appends_once_freezes_and_notices_changes(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path))
    rows = lambda ids: spark.createDataFrame([("j", "c", i, "h", '{"score": 2}') for i in ids], "judge string, condition string, unit_id string, prompt_sha256 string, raw_response string")
    with pytest.raises(Frozen):
        store.read()
    assert store.append(rows("ab")) == 2
    for again in ("bc", "dd"):
        with pytest.raises(ValueError):
            store.append(rows(again))
    targets = rows("abc").select("judge", "condition", "unit_id")
    assert [r["unit_id"] for r in store.missing(targets).collect()] == ["c"]
    store.freeze()
    with pytest.raises(Frozen):
        store.append(rows("z"))
    with pytest.raises(Frozen):
        store.freeze()
    assert {r["score"] for r in classify(store.read("j", "c")).collect()} == {2}
    assert not store._there(store.lock) and not list(tmp_path.glob("_staged*"))
    victim = next((tmp_path / "records").rglob("*.json"))
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)  # else the file system itself refuses
    victim.write_text(victim.read_text() + "\n")
    with pytest.raises(ValueError):
        store.read()


def _rows(spark, ids, condition="c"):
    return spark.createDataFrame([("j", condition, i, "h", "{}") for i in ids], "judge string, condition string, unit_id string, prompt_sha256 string, raw_response string")


def test_one_writer_at_a_time(spark, tmp_path):
    one, two = ScoreStore(spark, f"file:{tmp_path}/s"), ScoreStore(spark, f"file:{tmp_path}/s")
    assert one.append(_rows(spark, "ab")) == 2
    with one._locked():
        for other in (lambda: two.append(_rows(spark, "c")), two.freeze):
            with pytest.raises(Busy):
                other()
    assert two.append(_rows(spark, "c")) == 1 and one.records().count() == 3
    with pytest.raises(ValueError):
        one.append(_rows(spark, "cd"))
    assert one.append(_rows(spark, "d", "other")) == 1
    two.freeze()
    assert one.read().count() == 4 and one.read("j", "other").count() == 1


def test_concurrent_appends_write_each_key_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def attempt(k):
        store = ScoreStore(spark, str(tmp_path / "s"))
        for _ in range(200):
            try:
                return store.append(_rows(spark, ["same", f"own{k}"]))
            except Busy:
                time.sleep(0.1)
            except ValueError:
                return 0
        return None

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(attempt, range(3))) == [0, 0, 2]
    assert ScoreStore(spark, str(tmp_path / "s")).records().count() == 2


def test_a_lock_let_go_meanwhile_is_no_error(spark, tmp_path):
    one, two = ScoreStore(spark, str(tmp_path / "s")), ScoreStore(spark, str(tmp_path / "s"))
    two._there = lambda path: False  # as if the lock went between the two looks at it
    with one._locked(), pytest.raises(Busy), two._locked():
        pass
    with two._locked():
        pass


def test_two_writers_never_hold_the_lock(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    inside, held = [], []

    def attempt(k):
        store = ScoreStore(spark, str(tmp_path / "s"))
        for _ in range(40):
            try:
                with store._locked():
                    inside.append(k)
                    held.append(len(inside))
                    time.sleep(0.002)
                    inside.remove(k)
            except Busy:
                time.sleep(0.001 * k)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(attempt, range(6)))
    assert held and max(held) == 1


def test_a_store_by_another_scheme(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    (tmp_path / "in").mkdir()
    conf.set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}/in")
    store = ScoreStore(spark, "viewfs://kept/in/s")
    assert store.append(_rows(spark, "ab", "x y")) == 2
    store.freeze()
    assert store.read().count() == 2
    victim = next((tmp_path / "in").rglob("part*.json"))
    lines = victim.read_text().replace('"h"', '"g"')
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    victim.write_text(lines)
    with pytest.raises(ValueError):
        store.read()


def test_planted_prompt_errors_are_found(spark):
    prompts = spark.createDataFrame([("c", i, f"prompt {i}") for i in range(6)], "condition string, unit_id long, prompt string")
    stored = prompts.select(F.lit("j").alias("judge"), "condition", F.col("unit_id").cast("string").alias("unit_id"), F.sha2(F.when(F.col("unit_id") == 3, "other").otherwise(F.col("prompt")), 256).alias("prompt_sha256"),
        F.when(F.col("unit_id").isin(1, 2), "timeout").alias("error_status"), F.when(F.col("unit_id") == 1, 3).otherwise(0).alias("retry_count"), F.lit("m").alias("provider_model"), F.when(F.col("unit_id") != 4, "r").alias("provider_request_id"), F.lit(7).alias("prompt_tokens"))
    row = verify_prompts(stored, prompts.filter("unit_id <> 5")).first()
    assert row[2:] == (6, 4, 1, 1, 2, 1, 1)


def test_classification(spark):
    df = spark.createDataFrame([('{"score": 3}', None), ("x", ""), ('{"score": 3}', "timeout")], "raw_response string, error_status string")
    assert [tuple(r) for r in classify(df).select("score", "outcome").collect()] == [(3, "ok"), (None, "invalid"), (None, "technical")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.5, 0.4, 0.6)], "scenario string, rejection_rate double, ci_low double, ci_high double").select("scenario", report.rate_cell().alias("cell"))
    assert "0.500 [0.400, 0.600]" in report.markdown(df) and r"a\_b" in report.latex(df)
    files.write_report(str(tmp_path / "d/r.json"), {"b": 1, "a": [2]})
    assert json.loads((tmp_path / "d/r.json").read_text()) == {"a": [2], "b": 1}


def test_stream_scores_each_unit_once(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "unit_id long, ts timestamp, text string"
    spark.sql("SELECT id % 5 AS unit_id, timestamp'2024-01-01 00:00:00' AS ts, concat('t', id % 5) AS text FROM range(20)").write.parquet(source)
    q = score_stream(spark.readStream.schema(schema).parquet(source), "j").writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) AS n, count(DISTINCT unit_id) AS k FROM scored").first() == (5, 5)
