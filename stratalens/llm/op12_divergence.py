"""Source divergence audit: which sources of a language use its words unlike each other, and which words set a source apart.

Terms are runs of ASCII letters and of anything outside ASCII; only A to Z are
lower-cased. Each language keeps the V terms that at least MIN_DOCS of its documents
have. A group (language and source), and a language as a whole, gives each kept term
the smoothed share p = 1 + floor(SCALE * (count + 1) / (N + V)), N being its counts'
sum over kept terms. A term's divergence of p from q is floor((p - q)^2 / q). Part
``pair`` sums it over all kept terms for each two sources of a language; part ``term``
ranks a group's own terms (p over the language's q) to rank TOP.

Both go by count cells. Terms of equal counts have equal values, so terms are counted
by cell: (group count, language count) for the ranking, (count here, count there) for
a pair of sources. f is evaluated once a cell. Cells of equal value merge, values rank
by the cumulative multiplicity of those before them, and only values that begin within
TOP are expanded to terms, in UTF-8 order. Of a pair's cells, those with a 0 follow
from each group's own counts, so only terms that both sources have meet.

Null text, language and source count as ''. Rows may repeat, each is a document;
other columns are ignored. A group without kept terms has N = 0; where V = 0 all its
pairs have value 0. An empty table gives an empty result. All arithmetic is of
integers; counts times SCALE are decimals, so they may pass 2^63.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, cut, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
GROUP = ["lang", "source"]


def integral(a: Column, b: Column) -> Column:
    """a div b, exactly."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among so many occurrences of so many terms (at least one)."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + integral(wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms))


def divergence(p: Column, q: Column) -> Column:
    return integral((p - q) * (p - q), q)


def occurrences(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it); a null term stands for documents without terms."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lower = F.translate(plain(text), string.ascii_uppercase, string.ascii_lowercase)
    rows = df.select(plain(lang).alias("lang"), plain(source).alias("source"), F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    # a document's terms as they occur, then each of them once
    lists = F.array(F.struct(F.col("terms"), F.lit(1).alias("n")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(0).alias("n")))
    lists = rows.select(*GROUP, F.inline(lists))
    words = lists.select(*GROUP, F.explode_outer("terms").alias("term"), "n")
    return words.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum(1 - F.col("n")).alias("docs"))


def kept_terms(counted: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, lang_n and held (source and n of each source that has it, by source) of the terms in enough documents."""
    held = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("held")  # one entry a source of the language
    terms = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), held)
    return terms.filter(F.col("docs") >= min_docs).drop("docs")


def group_totals(counted: DataFrame, own: DataFrame) -> DataFrame:
    """Of every group: total (N), lang_total, v (V), zero (p of count 0) and cells (p and multiplicity of its other counts), all null where V is 0 but total."""
    cells = own.groupBy(*GROUP, "n").agg(F.count("*").alias("m"))
    groups = cells.groupBy(*GROUP).agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.collect_list(F.struct("n", "m")).alias("counts"))
    # distinct counts of a group number about the square root of its occurrences at most
    every = counted.select(*GROUP).distinct().join(groups, GROUP, "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    return every.withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<n:bigint,m:bigint>>")))


def pair_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value.

    With m(x, y) the number of terms of counts x and y, the sum of m f over all cells is
    V f(0,0), and for each own count x of either side its multiplicity times f(x,0) - f(0,0)
    or f(0,x) - f(0,0), and for the terms of both f(x,y) - f(x,0) - f(0,y) + f(0,0).
    """
    at = kept.select("lang", "held", F.posexplode("held").alias("at", "a"))
    both = at.select("lang", "a", F.explode(F.expr("slice(held, at + 2, size(held))")).alias("b"))
    cells = both.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(F.count("*").alias("m"))
    side = totals.filter("v > 0").select("lang", "source", "total", "v", "zero")
    here = side.select("lang", F.col("source").alias("a"), F.col("total").alias("na"), "v", F.col("zero").alias("za"))
    there = side.select("lang", F.col("source").alias("b"), F.col("total").alias("nb"), F.col("zero").alias("zb"))
    placed = cells.join(here, ["lang", "a"]).join(there, ["lang", "b"]).withColumns({"p": share(F.col("x"), F.col("na"), F.col("v")), "q": share(F.col("y"), F.col("nb"), F.col("v"))})
    p, q, za, zb, m = (F.col(c) for c in ("p", "q", "za", "zb", "m"))
    met = lambda p, q, za, zb: F.sum(m * (divergence(p, q) - divergence(p, zb) - divergence(za, q) + divergence(za, zb)))
    summed = placed.groupBy("lang", "a", "b").agg(met(p, q, za, zb).alias("there"), met(q, p, zb, za).alias("back"))
    shared = summed.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("there").alias("shared")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("shared")))))
    other = totals.select("lang", F.col("source").alias("item"), F.col("zero").alias("zb"), F.col("cells").alias("cells_b"))
    pairs = totals.withColumnsRenamed({"zero": "za", "cells": "cells_a"}).join(other, "lang").filter("source <> item")  # as many rows as the result
    none = divergence(za, zb)
    alone = lambda cells, f: F.aggregate(cells, F.lit(0).cast("long"), lambda acc, c: acc + c["m"] * (f(c["p"]) - none))
    base = F.col("v") * none + alone("cells_a", lambda p: divergence(p, zb)) + alone("cells_b", lambda q: divergence(za, q))
    out = pairs.select(*GROUP, "item", F.when(F.col("v") > 0, base).otherwise(F.lit(0)).alias("base")).join(shared, [*GROUP, "item"], "left")
    return out.select(*GROUP, "item", (F.col("base") + F.coalesce("shared", F.lit(0))).alias("value"))


def term_ranks(own: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """lang, source, item (a term of the group with p over q), value and rank to top."""
    cells = own.groupBy(*GROUP, "n", "lang_n").agg(F.count("*").alias("m")).join(totals.select(*GROUP, "total", "lang_total", "v"), GROUP)
    cells = cells.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"))}).filter("p > q")
    cells = cells.select(*GROUP, "n", "lang_n", "m", divergence(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    merged = cells.groupBy(*GROUP, "value").agg(F.sum("m").alias("m"))
    # each value has a term at least, so top values are enough; the limit goes before the shuffle
    first = merged.withColumn("place", F.row_number().over(by_value)).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    wanted = first.select(*GROUP, "value", before).filter(F.col("before") < top)
    chosen = cells.drop("m").join(wanted, [*GROUP, "value"])
    terms = own.join(chosen, [*GROUP, "n", "lang_n"])
    among = F.row_number().over(Window.partitionBy(*GROUP, "value").orderBy("term"))
    terms = terms.select(*GROUP, F.col("term").alias("item"), "value", "before", among.alias("place")).filter(F.col("place") <= top)
    return terms.select(*GROUP, "item", "value", (F.col("before") + F.col("place")).cast("int").alias("rank")).filter(F.col("rank") <= top)


def audit_sources(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank; the documents are read once."""
    scratch = Scratch(df.sparkSession)
    counted = scratch.keep(occurrences(df, text, lang, source))
    kept = scratch.keep(kept_terms(counted, min_docs))
    own = kept.select("lang", "term", "lang_n", F.inline("held"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = group_totals(counted, own).join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))
    cells = F.transform("counts", lambda c: F.struct(share(c["n"], F.col("total"), F.col("v")).alias("p"), c["m"].alias("m")))
    totals = scratch.keep(groups.select(*GROUP, "total", "lang_total", "v", zero.alias("zero"), cells.alias("cells")))
    ranked = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))  # a row a source
    pairs = pair_values(kept, totals).select(*GROUP, F.lit("pair").alias("part"), "item", "value", ranked.cast("int").alias("rank"))
    out = pairs.unionByName(term_ranks(own, totals, top).withColumn("part", F.lit("term")))
    out = cut(out)
    scratch.drop(counted, kept, totals)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS n FROM s LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p, 1 + ({SCALE}::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x QUALIFY part = 'pair' OR rank <= {TOP}"""
