"""N-gram Jaccard join of documents with adaptive multi-match prefixes.

A document's set is that of its five-word shingles (the whole sequence where it
has fewer words; nothing without words). Documents link where they share at least
80 hundredths of their union; classes are the connected components of the links.

Equal sets are one node. A node's prefix is lengthened by l - 1 keys, l from 1 to
MOST_SHARED, where the estimated number of candidates of its prefix keys makes
that cheaper; a pair is verified only if it shares as many prefix keys as the
smaller l of the two. Every node is first compared with the hub it shares most
prefix keys with; after that only pairs of different classes are sought, from the
nodes outside a key's largest class. All links between different classes are
found, so the classes are exact, while no group is turned into all its pairs.

Shingles are identified by 64-bit hashes and sets by 64-bit digests. Null and
empty texts have empty sets and are classes of their own. Of rows with one
doc_id each is linked by its own text. Null ids take part, but name no class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, append_columns, fresh, lean, table
from .setjoin import BROADCAST_DOCS, HEAVY, compatible, components, differing, folded, perhaps_similar, postings, prefix_length, room, signature, similar, stars
from .tokens import Levels, levels, mix, shingles, words_by_row

BITS = 18
MOST_SHARED = 4
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 50.0
#: Words of 64 bits of the signatures that go with keys; whole ones are as long as their sets ask for.
SIGN_WORDS = 16

_ONE = np.uint64(0x9E3779B97F4A7C15)


def digest(keys: np.ndarray) -> int:
    """A signed 64-bit digest of a set of keys."""
    x = mix(keys * _ONE + np.uint64(len(keys))).sum(dtype=np.uint64)
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def matches_wanted(keys: np.ndarray, table: Levels) -> int:
    """l: how many shared prefix keys make verification worth while, at the least estimated cost.

    With l keys asked for, the lists of l - 1 more keys are read, and about
    1 / l**2 of the sets on them are verified.
    """
    p = prefix_length(len(keys), MOST_SHARED - 1)
    read = np.cumsum(table.occurrences(keys[:p]))
    first = prefix_length(len(keys))
    costs = [read[first + l - 2] * (1 + VERIFY_COST / l**2) for l in range(1, MOST_SHARED + 1) if first + l - 1 <= p]  # noqa: E741
    return 1 + int(np.argmin(costs))


def shingle_parts(column: pa.Array):
    for _, words in words_by_row(column):
        yield shingles(words)


def with_sets(docs: DataFrame, table: Levels, what: str) -> DataFrame:
    """docs (doc_id, text) with n, node, l and what of the set: its prefix, all its keys, or its sign. node is null for empty sets."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    fields = [("n", "int"), ("node", "long"), ("l", "int"), (what, "array<long>")]

    def factory():
        known = shared.value

        def compute(batch):
            rows = len(batch)
            n, node, ls = np.zeros(rows, np.int32), [None] * rows, np.ones(rows, np.int32)
            lists: list[np.ndarray] = [np.zeros(0, np.int64)] * rows
            for row, words in words_by_row(batch.column(batch.schema.get_field_index("text"))):
                keys = np.unique(known.keys(shingles(words)))
                if len(keys):
                    n[row], node[row] = len(keys), digest(keys)
                    if what == "prefix":
                        ls[row] = matches_wanted(keys, known)
                        keys = keys[: prefix_length(len(keys), int(ls[row]) - 1)]
                    lists[row] = signature(keys) if what == "sign" else keys.view(np.int64)
            ends = np.cumsum([0, *map(len, lists)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if rows else np.zeros(0, np.int64)))
            return [pa.array(n), pa.array(node, pa.int64()), pa.array(ls), flat]

        return compute

    return append_columns(docs, fields, factory).drop("text")


def link_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows, classes = _classes(docs.select(F.col(doc_id).alias("doc_id"), th.alias("th"), F.col(text).alias("text")), heavy)
    names = classes.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = classes.join(names, "comp").select("node", "component_id")
    out = rows.filter("node IS NOT NULL").select("doc_id", "n", "node").join(named, "node").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("node IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows of docs that come first in their class, by id and then by the text's hash; rows equal in both are one.

    Rows with empty sets all stay, but for repeats.
    """
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows, classes = _classes(docs.select(F.col(doc_id).alias("doc_id"), th.alias("th"), F.col(text).alias("text")), heavy)
    filled = rows.filter("node IS NOT NULL").select("doc_id", "th", "node").join(classes.select("node", "comp"), "node")
    first = filled.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    i, h, own = fresh(docs, "id_of", "hash_of", "hash_own")
    kept = first.unionByName(rows.filter("node IS NULL").select("doc_id", "th")).select(F.col("doc_id").alias(i), F.col("th").alias(h))
    keyed = docs.withColumn(own, th)
    keyed = keyed.join(kept, F.col(f"`{doc_id}`").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left_semi")
    return keyed.dropDuplicates([doc_id, own]).drop(own)


def _classes(docs: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, th, text and others) with n and node instead of text; node, first_id (null only if no row has an id), first_th and comp of every node."""
    scratch = Scratch(docs.sparkSession)
    with lean(docs.sparkSession):
        known = levels(docs.select("text"), shingle_parts, BITS)
    rows = scratch.keep(with_sets(docs, known, "prefix"))
    filled = rows.filter("node IS NOT NULL")
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("o")
    nodes = filled.groupBy("node").agg(holder).select("node", F.col("o.doc_id").alias("first_id"), F.col("o.th").alias("first_th"))
    sets = filled.groupBy("node").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.first("prefix").alias("prefix"))
    shared = scratch.keep(postings(sets, known.floor, heavy))

    def sets_of(pairs: DataFrame, what: str) -> DataFrame:
        """node, n and what of the sets of the nodes of pairs, from the texts that first hold them."""
        wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        held = scratch.keep(nodes.join(wanted, "node").select("first_id", "first_th").distinct())
        few = F.broadcast(held) if held.count() <= BROADCAST_DOCS else held
        texts = docs.join(few, docs["doc_id"].eqNullSafe(F.col("first_id")) & (docs["th"] == F.col("first_th")), "left_semi")
        # rows equal in id and text, as copies without ids are, hold the same set
        return with_sets(texts, known, what).select("node", "n", what).dropDuplicates(["node"])

    best = stars(shared).groupBy("node").agg(F.max_by("hub", F.struct("shares", "hub")).alias("hub"))
    pairs = scratch.keep(best.select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")).distinct())
    links = scratch.keep(similar(pairs, sets_of(pairs, "keys")))
    classes = components(links, scratch)

    # what is left: pairs of different classes that share keys and whose signatures leave room for a link
    classed = shared.select("token", "node", "n", "l", "pos").join(classes.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classed = scratch.keep(classed)
    scratch.drop(shared)
    counted = classed.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = counted.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count("*").alias("classes")).filter("classes > 1").drop("classes")
    member = scratch.keep(classed.join(mixed, "token"))
    scratch.drop(classed)
    few = member.select(F.col("node").alias("x"), F.col("node").alias("y")).distinct()
    signs = scratch.keep(sets_of(few, "sign"))
    member = member.join(signs.select("node", folded("sign", F.lit(SIGN_WORDS)).alias("sign")), "node")
    minor = member.filter("comp <> major").alias("a")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    once = (b("comp") == b("major")) | (a("node") < b("node"))
    alike = differing("a.sign", "b.sign") <= room(a("n"), b("n"))
    met = minor.join(member.alias("b"), (a("token") == b("token")) & (a("comp") != b("comp")) & once & compatible(a, b) & alike)
    met = met.select(F.least(a("node"), b("node")).alias("x"), F.greatest(a("node"), b("node")).alias("y"), F.least(a("l"), b("l")).alias("l"))
    more = scratch.keep(met.groupBy("x", "y").agg(F.count("*").alias("shares"), F.min("l").alias("l")).filter("shares >= l").select("x", "y"))
    more = scratch.keep(perhaps_similar(more, signs).select("x", "y"))
    found = similar(more, sets_of(more, "keys"))
    joined = classes.select(F.col("node").alias("x"), F.col("comp").alias("y")).filter("x <> y")  # the first links, as stars
    classes = components(joined.unionByName(found), scratch)
    named = scratch.keep(nodes.join(classes.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    slim = scratch.keep(rows.drop("l", "prefix"))
    scratch.drop(*(df for _, df in [*scratch.paths.values()] if df is not named and df is not slim))
    return slim, named


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))


#: Links by counting shared shingles of every pair that shares one; classes by recursion from the least id.
SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
g AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS seen FROM w UNION SELECT g.y, r.seen FROM r JOIN g ON g.x = r.id WHERE r.seen <= g.y),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.id = w.doc_id
"""
