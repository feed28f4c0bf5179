"""Queries of joins, windows, sorts, sets, text functions and sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import report
from ..functions import text
from ..operators import binning, frame, missingness, multiplicity, ranks, sampling, strata
from ..plans import logistic, power, scoring, shared
from ..sources import files, store
from .registry import LABELLED, ORDERS, events, labelled, orders, query, table


@query("p4_complete_cases", """SELECT conv_id, count(*) AS n FROM conversations WHERE trim(coalesce(role, '')) <> '' AND regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> '' GROUP BY conv_id""")
def complete_cases(spark, d):
    return frame.complete_cases(table(spark, d, "conversations"), ["role", "text"]).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("p13_augmented_key", """SELECT concat_ws('|', lang, CAST(length(text) > 500 AS INT)) AS z, count(*) AS n, count(*) FILTER (length(text) = n_chars) AS same_length FROM documents GROUP BY 1""")
def augmented_key(spark, d):
    t = table(spark, d, "documents")
    z = frame.composite_key(F.col("lang"), (F.char_length("text") > 500).cast("int"))
    return t.groupBy(z.alias("z")).agg(F.count("*").alias("n"), F.count_if(F.char_length("text") == F.col("n_chars")).alias("same_length"))


@query("p19_degenerate_units", f"""WITH {LABELLED}, s AS (SELECT source, lang FROM o GROUP BY ALL HAVING count(DISTINCT a) >= 2) SELECT o.unit_id FROM o LEFT JOIN s ON o.source = s.source AND o.lang = s.lang WHERE s.source IS NULL ORDER BY o.unit_id LIMIT 8""")
def degenerate_units(spark, d):
    df = labelled(spark, d)
    z = ["source", "lang"]
    return df.join(strata.stratum_table(df, z).filter("informative").select(*z), z, "left_anti").orderBy("unit_id").limit(8).select("unit_id")


@query("p20_label_map", """WITH m AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS level FROM lineitem) SELECT l_orderkey, count(*) AS n, round_even(avg(level), 6) AS q, count(*) FILTER (level IS NULL) AS unexpected FROM m GROUP BY l_orderkey""")
def label_map(spark, d):
    level = F.create_map(F.lit("A"), F.lit(0), F.lit("N"), F.lit(1), F.lit("R"), F.lit(2))
    t = table(spark, d, "lineitem").select("l_orderkey", level[F.col("l_returnflag")].alias("level"))
    return t.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bround(F.avg("level"), 6).alias("q"), F.count_if(F.col("level").isNull()).alias("unexpected"))


@query("p22_column_quality", """SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (coalesce(text, '') = '') AS empty_text, count(*) FILTER (source IS NULL) AS no_cluster, count(DISTINCT source) AS clusters FROM documents""")
def column_quality(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_text"), F.count_if(F.col("source").isNull()).alias("no_cluster"), F.count_distinct("source").alias("clusters"))


@query("j1_covered_join", """SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def covered_join(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = files.covered(o, table(spark, d, "customer"), "c_custkey")
    return joined.groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j7_left_join", """SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def left_join(spark, d):
    labels = table(spark, d, "labels").withColumn("labelled", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("j9_complete_in_all", """SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
def complete_in_all(spark, d):
    t = table(spark, d, "events")
    k = t.agg(F.count_distinct("event_type").alias("k"))
    per = t.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return per.join(F.broadcast(k), F.col("kinds") == F.col("k")).select("user_id", "n")


@query("j11_work_list", """SELECT count(*) AS todo, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def work_list(spark, d):
    todo = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return todo.agg(F.count("*").alias("todo"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("j12_coverage", """SELECT c_custkey AS custkey, 'left' AS side FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'right' FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def coverage(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    return files.symmetric_difference(left, table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("j13_informative_members", f"""WITH {LABELLED}, s AS (SELECT source, lang FROM o GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT a) >= 2) SELECT unit_id FROM o JOIN s ON o.source = s.source AND o.lang = s.lang""")
def informative_members(spark, d):
    return strata.in_informative(labelled(spark, d), ["source", "lang"]).select("unit_id")


@query("j14_range_lookup", """SELECT p_partkey, CAST(len(list_filter([900.5, 1100.0, 1300.0, 1500.0, 1700.0], lambda e: e <= p_retailprice)) AS INT) AS bin FROM part""")
def range_lookup(spark, d):
    return table(spark, d, "part").select("p_partkey", binning.fixed_cuts((900.5, 1100.0, 1300.0, 1500.0, 1700.0), F.col("p_retailprice")).alias("bin"))


@query("j17_grid_with_skips", """WITH g AS (SELECT r_name, s AS segment, b FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT unnest([0, 1]) AS b)),
c AS (SELECT r_name, c_mktsegment, CAST(c_acctbal < 0 AS INT) AS b, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT g.r_name, segment, CAST(g.b AS INT) AS overdrawn, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.r_name = c.r_name AND segment = c_mktsegment AND g.b = c.b""")
def grid_with_skips(spark, d):
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    counts = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    counts = counts.groupBy("r_name", F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).cast("int").alias("overdrawn")).agg(F.count("*").alias("n"))
    grid = region.select("r_name").crossJoin(customer.select(F.col("c_mktsegment").alias("segment")).distinct()).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("overdrawn")))
    return grid.join(counts, ["r_name", "segment", "overdrawn"], "left").na.fill(0, ["n"])


@query("j18_wide_table", """SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2) AS f_total, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 2) AS o_total, sign(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 0) - coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 0)) AS direction FROM lineitem GROUP BY l_returnflag""")
def wide_table(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_extendedprice"))
    direction = F.signum(F.coalesce("F", F.lit(0.0)) - F.coalesce("O", F.lit(0.0))).cast("tinyint")
    return wide.select("l_returnflag", F.round("F", 2).alias("f_total"), F.round("O", 2).alias("o_total"), direction.alias("direction"))


@query("j19_hash_compare", """SELECT count(*) AS n, count(DISTINCT sha256('T:' || text)) AS prompts, count(*) FILTER (sha256('T:' || text) = sha256(concat('T:', text))) AS same FROM documents""")
def hash_compare(spark, d):
    prompt = text.render("T:[[X]]", [("[[X]]", F.col("text"))])
    t = table(spark, d, "documents").select(F.sha2(prompt, 256).alias("stored"), F.sha2(F.concat(F.lit("T:"), "text"), 256).alias("again"))
    return t.agg(F.count("*").alias("n"), F.count_distinct("stored").alias("prompts"), F.count_if(F.col("stored") == F.col("again")).alias("same"))


@query("a23_value_frequencies", """SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*) FROM events GROUP BY hour(ts)""")
def value_frequencies(spark, d):
    t = table(spark, d, "events")
    one = lambda name, c: t.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("field"), "value", "n")
    return one("event_type", F.col("event_type")).unionByName(one("hour", F.hour("ts")))


@query("a33_nested_means", """SELECT round(avg(m), 6) AS mean_of_means, round(avg(sd), 6) AS mean_sd FROM (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id)""")
def nested_means(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return per.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.avg("sd"), 6).alias("mean_sd"))


@query("a34_pearson", """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 9) AS pearson FROM lineitem GROUP BY l_returnflag""")
def pearson(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr(F.col("l_quantity").cast("double"), "l_extendedprice"), 9).alias("pearson"))


@query("a40_usage", """WITH r AS (SELECT role AS judge, conv_id % 3 AS condition, length(text) AS tin, turn + 1 AS tout, turn % 2 AS retry FROM conversations)
SELECT judge, CAST(condition AS VARCHAR) AS condition, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, CAST(sum(retry) AS BIGINT) AS retries, count(*) FILTER (retry = 1 AND tout > 3) AS errors, round_even(sum(tin) / 1e6 * 250 + sum(tout) / 1e6 * 1000, 2) AS cost FROM r GROUP BY ALL""")
def usage(spark, d):
    t = table(spark, d, "conversations")
    r = t.select(F.col("role").alias("judge"), (F.col("conv_id") % 3).cast("string").alias("condition"), F.char_length("text").cast("long").alias("prompt_tokens"), (F.col("turn") + 1).alias("completion_tokens"), F.lit(None).cast("long").alias("thinking_tokens"), (F.col("turn") % 2).alias("retry_count"), F.when((F.col("turn") % 2 == 1) & (F.col("turn") > 2), "timeout").alias("error_status"))
    return store.usage(r, 250, 1000)


@query("a53_direction_agreement", """WITH s AS (SELECT source, lang, avg(n_chars) FILTER (doc_id % 2 = 0) - avg(n_chars) FILTER (doc_id % 2 = 1) AS g FROM documents GROUP BY source, lang)
SELECT source, count(g) AS cells, count(DISTINCT sign(g)) = 1 AS same_direction, count(*) FILTER (abs(g) > 1000) AS rejections FROM s GROUP BY source""")
def direction_agreement(spark, d):
    t = table(spark, d, "documents")
    mean = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("n_chars")))
    s = t.groupBy("source", "lang").agg((mean(0) - mean(1)).alias("g"))
    return s.groupBy("source").agg(F.count("g").alias("cells"), (F.count_distinct(F.signum("g")) == 1).alias("same_direction"), F.count_if(F.abs("g") > 1000).alias("rejections"))


@query("a54_positions", """WITH p AS (SELECT o_orderkey, o_orderstatus, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
t AS (SELECT *, len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda k: floor(n * k / 10.0) <= pos)) AS decile FROM p) SELECT CAST(decile AS INT) AS decile, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS excluded, min(pos) AS low, max(pos) AS high FROM t GROUP BY decile""")
def positions(spark, d):
    w = Window.partitionBy("o_custkey")
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("n"))
    return missingness.position_deciles(t, "pos", "n").groupBy("decile").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("excluded"), F.min("pos").alias("low"), F.max("pos").alias("high"))


@query("w10_time_tenths", """WITH t AS (SELECT epoch_us(ts) / 1000000.0 AS t, value FROM events), q AS (SELECT quantile_cont(t, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM t) SELECT CAST(len(list_filter(q, lambda e: e <= t)) AS INT) AS tenth, count(*) AS n, round(avg(value), 6) AS mean FROM t, q GROUP BY 1""")
def time_tenths(spark, d):
    t = table(spark, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), "value")
    return missingness.time_tenths(t, "t").groupBy("tenth").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("a56_constant_metadata", """SELECT o_custkey, count(DISTINCT o_orderstatus) AS variants FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1""")
def constant_metadata(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("variants")).filter("variants > 1")


@query("a57_duplicate_texts", """SELECT sha1(text) AS sha1, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY sha1(text) HAVING count(*) > 1""")
def duplicate_texts(spark, d):
    return table(spark, d, "documents").groupBy(F.sha1("text").alias("sha1")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("w2_dense_codes", """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM part""")
def dense_codes(spark, d):
    return binning.dense(table(spark, d, "part"), "p_brand", "code").select("p_partkey", "code")


@query("w5_average_ranks", """SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY user_id, round(value, 0)) - 1) / 2.0 AS r FROM events""")
def average_ranks(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", F.round("value", 0).alias("v"))
    return ranks.average_ranks(t, "v", "r", ["user_id"]).select("event_id", "r")


@query("w6_one_per_cluster", """SELECT CAST(o_custkey AS VARCHAR) AS cluster_key, arg_min(o_orderkey, sha256('7:' || o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def one_per_cluster(spark, d):
    return sampling.one_per_cluster(table(spark, d, "orders"), "o_orderkey", "o_custkey", 7)


@query("w7_first_per_key", """SELECT text_sha1, doc_id, source FROM (SELECT sha1(text) AS text_sha1, doc_id, source, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def first_per_key(spark, d):
    t = table(spark, d, "documents").select(F.sha1("text").alias("text_sha1"), "doc_id", "source")
    return files.first_of_key(t, ["text_sha1"], ["doc_id"])


@query("s6_last_per_key", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def last_per_key(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("order"))
    return files.last_of_key(t, "user_id", "order").select("user_id", "event_id", "event_type")


@query("s19_replace_keys", """SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, 9, 9 FROM labels WHERE doc_id % 10 = 3""")
def replace_keys(spark, d):
    old = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    new = old.filter("doc_id % 10 = 3").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return files.replace_keys(old, new, ["doc_id"])


@query("s18_union_of_files", """SELECT 'labels' AS source_file, count(*) AS n FROM labels UNION ALL SELECT 'documents', count(*) FROM documents""")
def union_of_files(spark, d):
    one = lambda name: table(spark, d, name).select("doc_id").withColumn("source_file", F.lit(name))
    return one("labels").unionByName(one("documents")).groupBy("source_file").agg(F.count("*").alias("n"))


ALLOCATION = """z AS (SELECT o_orderpriority AS z, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT *, 1001 * n / CAST(sum(n) OVER () AS DOUBLE) AS q FROM z), b AS (SELECT *, least(CAST(floor(q) AS BIGINT), n) AS b, q - floor(q) AS f FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN b < n THEN 0 ELSE 1 END, f DESC, z DESC) AS rk, 1001 - sum(b) OVER () AS short FROM b), al AS (SELECT z, n, CAST(b + CASE WHEN rk <= short AND b < n THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM r)"""


@query("m9_allocation", f"WITH {ALLOCATION} SELECT * FROM al")
def allocation(spark, d):
    return sampling.hamilton(orders(spark, d).groupBy("z").agg(F.count("*").alias("n")), 1001)


@query("r3_stratified_sample", f"""WITH {ALLOCATION}, u AS (SELECT o_orderkey AS unit_id, o_orderpriority AS z, CAST('0x' || sha256('sample:7741:' || o_orderpriority || ':' || o_orderkey)[1:13] AS BIGINT) AS u FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY u, unit_id) AS rk FROM u) SELECT unit_id, k.z FROM k JOIN al ON k.z = al.z WHERE rk <= allocated""")
def stratified_sample(spark, d):
    return sampling.stratified_sample(orders(spark, d), 1001, 7741)


@query("o4_top_two_share", """SELECT l_linestatus, round(sum(n) FILTER (r <= 2) / CAST(sum(n) AS DOUBLE), 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, l_quantity) AS r FROM (SELECT l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)) GROUP BY l_linestatus""")
def top_two_share(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_linestatus", "l_quantity").agg(F.count("*").alias("n"))
    top = F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 2)
    return c.groupBy("l_linestatus").agg(F.round(F.aggregate(top, F.lit(0).cast("long"), lambda a, x: a + x) / F.sum("n"), 9).alias("share"))


@query("o1_numeric_order", """SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders""")
def numeric_order(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return ranks.numbered(t.withColumn("number", F.col("id").cast("bigint")), "number", "r").drop("number")


@query("o7_first_appearance", """SELECT source, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INT) AS place FROM documents GROUP BY source""")
def first_appearance(spark, d):
    first = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return first.select("source", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"))


@query("v2_set_operations", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 90)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only""".replace("AS both", 'AS "both"'))
def set_operations(spark, d):
    t = table(spark, d, "events")
    a = t.filter("event_type = 'error'").select("user_id").distinct()
    b = t.filter("value > 90").select("user_id").distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.intersect(b), "both").crossJoin(count(a.exceptAll(b), "left_only")).crossJoin(count(b.exceptAll(a), "right_only"))


@query("f1_selection_order", """SELECT o_orderkey AS unit_id, row_number() OVER (ORDER BY sha256('5150:' || o_orderkey)) AS r FROM orders""")
def selection_order(spark, d):
    keyed = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), text.selection_key(5150, "o_orderkey").alias("k"))
    return ranks.in_hash_order(keyed, "k", "r").drop("k")


@query("f4_request_ids", """SELECT doc_id, sha256('judge/x|plain|' || doc_id)[1:16] AS request_id, replace('judge/x__' || source, '/', '_') AS file_name, sha1(text) AS text_sha1 FROM documents""")
def request_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", text.request_id("judge/x", "plain", "doc_id").alias("request_id"), text.safe_name(F.lit("judge/x"), F.col("source")).alias("file_name"), F.sha1("text").alias("text_sha1"))


@query("f5_rendered_prompts", """WITH p AS (SELECT conv_id, turn, replace(replace('RULES' || chr(10) || 'RUBRIC' || chr(10) || '{A} / {E}', '{A}', role), '{E}', text) AS p FROM conversations),
q AS (SELECT conv_id, turn, CASE WHEN strpos(p, 'RUBRIC' || chr(10)) > 0 THEN substr(p, 1, strpos(p, 'RUBRIC' || chr(10)) - 1) || 'IGNORE' || chr(10) || substr(p, strpos(p, 'RUBRIC' || chr(10))) ELSE p END AS p FROM p) SELECT conv_id, turn, sha256(p) AS prompt_sha256, length(p) AS n FROM q""")
def rendered_prompts(spark, d):
    t = table(spark, d, "conversations")
    p = text.insert_before(text.render("RULES\nRUBRIC\n{A} / {E}", [("{A}", F.col("role")), ("{E}", F.col("text"))]), "RUBRIC\n", "IGNORE\n")
    return t.select("conv_id", "turn", F.sha2(p, 256).alias("prompt_sha256"), F.char_length(p).cast("long").alias("n"))


RESPONSES = """r AS (SELECT event_id, CASE event_id % 12 WHEN 0 THEN props WHEN 1 THEN '{"score": ' || (event_id % 9) || '}' WHEN 2 THEN ' {"score":' || (event_id % 7) || '} ' WHEN 3 THEN '{"score": 3.5}' WHEN 4 THEN '{"score": "3"}' WHEN 5 THEN '{"score": true}' WHEN 6 THEN '{"Score": 3}' WHEN 7 THEN '{"score": 3, "why": "x"}' WHEN 8 THEN 'The score is {"score": 3}' WHEN 9 THEN '' WHEN 10 THEN '[3]' WHEN 11 THEN '{"score": null}' END AS response FROM events)"""


def _responses(spark, d):
    t = table(spark, d, "events")
    k = F.col("event_id") % 12
    fixed = {3: '{"score": 3.5}', 4: '{"score": "3"}', 5: '{"score": true}', 6: '{"Score": 3}', 7: '{"score": 3, "why": "x"}', 8: 'The score is {"score": 3}', 9: "", 10: "[3]", 11: '{"score": null}'}
    r = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('{"score": '), F.col("event_id") % 9, F.lit("}"))).when(k == 2, F.concat(F.lit(' {"score":'), F.col("event_id") % 7, F.lit("} ")))
    for i, v in fixed.items():
        r = r.when(k == i, F.lit(v))
    return t.select("event_id", r.alias("response"))


@query("f7_strict_scores", f"""WITH {RESPONSES}, s AS (SELECT event_id, CAST(nullif(regexp_extract(response, '^\\s*\\{{\\s*"score"\\s*:\\s*([0-9]+)\\s*\\}}\\s*$', 1), '') AS INT) AS s FROM r) SELECT event_id, CASE WHEN s BETWEEN 1 AND 6 THEN s END AS score, CASE WHEN s BETWEEN 1 AND 5 THEN s END AS score5 FROM s""")
def strict_scores(spark, d):
    return _responses(spark, d).select("event_id", text.strict_score("response").alias("score"), text.strict_score("response", 1, 5).alias("score5"))


@query("f9_refusals", f"""WITH {RESPONSES}, s AS (SELECT CASE event_id % 12 WHEN 0 THEN 'wrong keys' WHEN 3 THEN 'wrong type' WHEN 4 THEN 'wrong type' WHEN 5 THEN 'wrong type' WHEN 6 THEN 'wrong keys' WHEN 7 THEN 'wrong keys' WHEN 8 THEN 'not json' WHEN 9 THEN 'not json' WHEN 10 THEN 'wrong keys' WHEN 11 THEN 'wrong type'
WHEN 1 THEN CASE WHEN event_id % 9 NOT BETWEEN 1 AND 6 THEN 'out of range' END WHEN 2 THEN CASE WHEN event_id % 7 = 0 THEN 'out of range' END END AS reason FROM r) SELECT reason, count(*) AS n FROM s GROUP BY reason""")
def refusals(spark, d):
    return _responses(spark, d).groupBy(text.refusal("response").alias("reason")).agg(F.count("*").alias("n"))


def _stored(spark, records, use):
    """use(store) of a frozen store of records in the shared folder, computed; the store goes afterwards."""
    kept = store.ScoreStore(spark, f"{shared.folder(spark)}/store-{uuid.uuid4().hex}")
    kept.append(records)
    kept.freeze()
    out = shared.cut(use(kept))
    kept.fs.delete(kept._path(kept.root), True)
    return out


@query("s12_score_store", f"""WITH {RESPONSES}, s AS (SELECT event_id, CAST(nullif(regexp_extract(response, '^\\s*\\{{\\s*"score"\\s*:\\s*([0-9]+)\\s*\\}}\\s*$', 1), '') AS INT) AS s FROM r),
c AS (SELECT 'c' || (event_id % 3) AS condition, event_id % 11 = 0 AS failed, CASE WHEN event_id % 11 <> 0 AND s BETWEEN 1 AND 6 THEN s END AS score FROM s)
SELECT condition, CASE WHEN failed THEN 'technical' WHEN score IS NULL THEN 'invalid' ELSE 'ok' END AS outcome, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM c GROUP BY ALL""")
def score_store(spark, d):
    """Responses appended to a store, frozen, verified, read back and classed."""
    e = F.col("event_id")
    records = _responses(spark, d).select(F.lit("j").alias("judge"), F.concat(F.lit("c"), e % 3).alias("condition"), e.cast("string").alias("unit_id"), F.col("response").alias("raw_response"), F.when(e % 11 == 0, "timeout").alias("error_status"))
    return _stored(spark, records, lambda s: store.classify(s.read()).groupBy("condition", "outcome").agg(F.count("*").alias("n"), F.sum("score").alias("total")))


@query("j10_prompt_verification", """WITH r AS (SELECT doc_id, doc_id % 97 = 5 AS planted, doc_id % 50 = 1 AS failed, CASE WHEN doc_id % 100 = 1 THEN 2 WHEN doc_id % 50 = 1 THEN 3 ELSE 0 END AS retries, doc_id % 61 = 2 AS nameless, doc_id % 83 = 3 AS unknown FROM documents)
SELECT 'j' AS judge, 'plain' AS condition, count(*) AS records, count(*) FILTER (NOT unknown AND NOT planted) AS hash_ok, count(*) FILTER (NOT unknown AND planted) AS hash_bad, count(*) FILTER (unknown) AS unknown, count(*) FILTER (failed) AS failures, count(*) FILTER (failed AND retries <> 3) AS failures_without_retries, count(*) FILTER (NOT failed AND nameless) AS successes_without_source FROM r""")
def prompt_verification(spark, d):
    """Prompts of documents rendered anew and held against a frozen store with planted faults."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", text.render("Rate this.\nT:[[X]]", [("[[X]]", F.col("text"))]).alias("prompt"))
    records = docs.select(
        F.lit("j").alias("judge"), F.lit("plain").alias("condition"), i.cast("string").alias("unit_id"), F.sha2(F.when(i % 97 == 5, F.concat("prompt", F.lit("!"))).otherwise(F.col("prompt")), 256).alias("prompt_sha256"), F.lit('{"score": 3}').alias("raw_response"),
        F.when(i % 50 == 1, "timeout").alias("error_status"), F.when(i % 100 == 1, 2).when(i % 50 == 1, 3).otherwise(0).alias("retry_count"), F.lit("m").alias("provider_model"), F.when(i % 61 != 2, "r").alias("provider_request_id"), F.lit(9).alias("prompt_tokens"),
    )
    prompts = docs.filter(i % 83 != 3).select(F.lit("plain").alias("condition"), i.alias("unit_id"), "prompt")
    return _stored(spark, records, lambda s: store.verify_prompts(s.read(), prompts))


@query("s17_resumed_prefix", """SELECT CAST(count(*) AS BIGINT) AS rows, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, (SELECT count(*) FROM events WHERE event_id < (SELECT quantile_disc(event_id, 0.5) FROM events)) AS n FROM events) WHERE k <= n // 32 * 32""")
def resumed_prefix(spark, d):
    """The half of events that a torn log has scored, held against all events and cut to whole batches."""
    t = table(spark, d, "events")
    middle = ranks.quantiles(t, "event_id", [0.5], "q").select(F.floor(F.col("q")[0]).alias("middle"))
    done = shared.cut(t.crossJoin(F.broadcast(middle)).filter("event_id < middle").select("event_id", (F.col("event_id") * 2).alias("line")))
    return scoring.resumable(done, t, "line", "event_id", "event_id").agg(F.count("*").alias("rows"), F.max("event_id").alias("last_id"))


@query("t7_strata_grid", f"""WITH {LABELLED}, s AS (SELECT lang, source, count(*) AS n, count(*) FILTER (a = 1) AS n1, count(DISTINCT a) AS k FROM o GROUP BY ALL),
c AS (SELECT lang, source, n || '/' || n1 || CASE WHEN n >= 2 AND k >= 2 THEN '' ELSE '*' END AS c FROM s)
SELECT source, {", ".join(f"coalesce(max(c) FILTER (lang = '{x}'), '-') AS {x}" for x in ("de", "en", "es", "fr"))} FROM c GROUP BY source""")
def strata_grid(spark, d):
    return report.strata_grid(strata.stratum_table(labelled(spark, d), ["lang", "source"]), "source", "lang", ["de", "en", "es", "fr"])


@query("f12_epochs", """SELECT event_id, round(epoch_us(CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP)) / 1000000.0, 0) AS t FROM events""")
def epochs(spark, d):
    return table(spark, d, "events").select("event_id", F.round(text.epoch_seconds(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), 0).alias("t"))


@query("a52_logistic")
def logistic_model(spark, d):
    t = table(spark, d, "orders").select((F.col("o_orderstatus") == "P").cast("int").alias("y"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.round(F.col("o_totalprice") / 100000, 1).alias("price"))
    full, reduced = logistic.fit(t, ["urgent", "price"], "y"), logistic.fit(t, ["urgent"], "y")
    rows = [(n, b, se, z, o) for n, b, se, z, o in zip(["intercept", "urgent", "price"], full["beta"], full["se"], full["z"], full["odds"], strict=True)]
    stat, k = logistic.lrt(full, reduced)
    return spark.createDataFrame([*rows, ("lrt", stat, None, float(k), None)], "term string, value double, se double, z double, odds double")


@query("a55_power_cell")
def power_planning(spark, d):
    ordinal = events(spark, d).withColumn("s_raw", F.least(F.floor(F.col("s_raw") / 20), F.lit(5)) + 1)
    return power.power(ordinal, [500, 1500], [0.1, 0.5], 40, 199, 3307)


@query("a55_usable_strata", """WITH z AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS k FROM events GROUP BY user_id) SELECT count(*) FILTER (k > 0 AND k < n) AS usable, round(avg(n), 6) AS mean_n, round(avg(k), 6) AS mean_a1 FROM z""")
def usable_strata(spark, d):
    s = strata.stratum_table(events(spark, d))
    return s.agg(F.count_if("informative").alias("usable"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.avg("n_a1"), 6).alias("mean_a1"))


_DOWN = "CAST('0x' || sha256('down:' || l_orderkey || ':' || l_linenumber)[1:13] AS BIGINT) / 4503599627370496.0"


@query("m8_downshift", f"""SELECT CAST(greatest(1, least(6, l_linenumber + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END - CASE WHEN {_DOWN} < 0.3 THEN 1 ELSE 0 END)) AS INT) AS s, count(*) AS n FROM lineitem GROUP BY 1""")
def downshift(spark, d):
    lowered = sampling.uniform("down", F.col("l_orderkey"), F.col("l_linenumber")) < 0.3
    s = sampling.shifted(F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 0).otherwise(1), lowered)
    return table(spark, d, "lineitem").groupBy(s.cast("int").alias("s")).agg(F.count("*").alias("n"))


@query("x2_any_attribute", """SELECT CAST(greatest(l_discount * 5, l_tax * 10) >= 0.5 AS INT) AS a, count(*) AS n FROM (SELECT CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(38,18)) AS l_discount, CAST(CAST(l_tax AS VARCHAR) AS DECIMAL(38,18)) AS l_tax FROM lineitem) GROUP BY 1""")
def any_attribute(spark, d):
    t = table(spark, d, "lineitem")
    times = lambda c, k: (frame.exact(c) * k).cast(frame.DECIMAL)
    return t.groupBy(frame.any_at_least_half(times("l_discount", 5), times("l_tax", 10)).alias("a")).agg(F.count("*").alias("n"))


@query("t4_main_table", """WITH g AS (SELECT l_linestatus, l_returnflag, count(*) AS n, count(*) FILTER (l_discount <= 0.05) AS k FROM lineitem GROUP BY ALL),
w AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1 + 1.959963984540054 * 1.959963984540054 / n AS den FROM g),
x AS (SELECT *, (p + 1.959963984540054 * 1.959963984540054 / (2 * n)) / den AS c, 1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)) / den AS h FROM w),
y AS (SELECT l_linestatus, l_returnflag, printf('%.3f [%.3f, %.3f]', p, CASE WHEN k = 0 THEN 0.0 ELSE greatest(0.0, c - h) END, CASE WHEN k = n THEN 1.0 ELSE least(1.0, c + h) END) AS cell FROM x)
SELECT l_linestatus AS scenario, 'observed' AS null_status, max(cell) FILTER (l_returnflag = 'A') AS A, max(cell) FILTER (l_returnflag = 'N') AS N, max(cell) FILTER (l_returnflag = 'R') AS R FROM y GROUP BY l_linestatus""")
def main_table(spark, d):
    rates = multiplicity.rejection_rates(table(spark, d, "lineitem"), ["l_linestatus", "l_returnflag"], "l_discount", 0.05)
    rates = rates.select(F.col("l_linestatus").alias("scenario"), F.col("l_returnflag").alias("method"), F.lit("observed").alias("null_status"), F.lit(0).alias("n"), "rejection_rate", "ci_low", "ci_high")
    return report.main_table(rates, 0, ["A", "N", "R"])


@query("t5_size_table", """WITH r AS (SELECT l_linestatus AS scenario, CAST(l_linenumber AS INT) AS n, l_returnflag AS method, printf('%.3f', count(*) FILTER (l_discount <= 0.05) / CAST(count(*) AS DOUBLE)) AS cell FROM lineitem GROUP BY ALL)
SELECT scenario, n, coalesce(max(cell) FILTER (method = 'A'), '-') AS A, coalesce(max(cell) FILTER (method = 'N'), '-') AS N_, coalesce(max(cell) FILTER (method = 'R'), '-') AS R FROM r GROUP BY scenario, n""")
def size_table(spark, d):
    rates = multiplicity.rejection_rates(table(spark, d, "lineitem"), ["l_linestatus", "l_linenumber", "l_returnflag"], "l_discount", 0.05)
    rates = rates.select(F.col("l_linestatus").alias("scenario"), F.col("l_linenumber").cast("int").alias("n"), F.when(F.col("l_returnflag") == "N", "N_").otherwise(F.col("l_returnflag")).alias("method"), "rejection_rate")
    return report.size_table(rates, ["A", "N_", "R"])


@query("t4_report_pivot", f"""WITH {ORDERS} SELECT z, count(*) FILTER (a = 0) || '/' || count(*) AS kept, count(*) FILTER (a = 1) || '/' || count(*) AS shown FROM o GROUP BY z""")
def report_pivot(spark, d):
    s = strata.stratum_table(orders(spark, d))
    cell = lambda k: F.concat(k.cast("string"), F.lit("/"), F.col("n").cast("string"))
    return s.select("z", cell(F.col("n") - F.col("n_a1")).alias("kept"), cell(F.col("n_a1")).alias("shown"))


