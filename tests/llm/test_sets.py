"""Line dedup and the n-gram join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import op03_ngram_join, setjoin
from stratalens.llm.op02_line_dedup import dedup_lines, removed_lines
from stratalens.llm.op03_ngram_join import keep_one_of_each_class, link_classes
from stratalens.llm.tokens import blocks, shingles, words_by_row

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def brute_classes(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    comp = list(range(len(sets)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if linked(sets[x][1], sets[y][1]):
                comp[top(x)] = top(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return {i: least[top(k)] for k, (i, _) in enumerate(sets)}


def brute_removed(docs):
    seen, out = [], {}
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            s = set(words(line))
            if not s:
                continue
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                out.setdefault(i, set()).add(k)
            seen.append(s)
    return out


#: Every key is heavy, every group large, one candidate a key is written, asking nodes of a key are parted: all ways of the line join are taken.
NARROW = {"large": 1, "heavy": 1, "best": 1, "hubs": 1, "waiting": 1}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "中", "the", "of"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 30, 80]))) for _ in range(10)]
    docs = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 8])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w += rng.choice(base).split()
        sep = rng.choice([" ", "\n", " \t "])
        text = "".join(x + (sep if rng.random() < 0.9 else "\n") for x in w)
        docs.append((i, rng.choice([text, text.upper() if text.isascii() else text])))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, docs[0][1])]


@pytest.mark.parametrize("seed", range(4))
def test_classes_are_those_of_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = link_classes(df, heavy=setjoin.HEAVY if seed % 2 else 3).collect()
    want = brute_classes(docs)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(rows) == len(docs)
    assert all(r["n_shingles"] == len(shingle_set(dict(docs)[r["doc_id"]])) for r in rows)


def test_chains_and_stars_of_near_copies(spark):
    w = [f"x{i}" for i in range(200)]
    docs = []
    for i in range(40):  # each differs from the one before in one word, ends are far apart
        w = [*w]
        w[(i * 5) % 200] = f"y{i}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in link_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_one_of_each_class_stays_with_all_columns(spark):
    docs = corpus(9)
    rows = [(i, t, f"s{i}", 1) for i, t in docs] + [(0, docs[0][1], "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, node int")
    kept = keep_one_of_each_class(df)
    want = brute_classes(docs)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c if shingle_set(dict(docs)[i]) else i for i, c in want.items()})


@pytest.mark.parametrize("seed", range(4))
def test_removed_lines_are_those_of_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: set(r["removed"]) for r in removed_lines(df, **({} if seed % 2 else NARROW)).collect()}
    assert got == brute_removed(docs)


@pytest.mark.parametrize("how", [{"heavy": 1}, NARROW])
def test_long_lines_about_the_threshold(spark, how):
    rng = random.Random(11)
    docs = []
    for k in range(40):
        base = rng.sample([f"w{i}" for i in range(1500)], rng.choice([4, 9, 10, 20, 41, 90, 300, 700]))
        docs.append((3 * k, " ".join(base)))
        for j in (1, 2):  # of n words d are replaced: (n - d) / (n + d) is 0.8 at n / 9; or left out: 0.8 at n / 5
            n = len(base)
            other = [*base]
            rng.shuffle(other)
            other = [*other[n // 9 + j - 1 :], *(f"v{k}_{j}_{i}" for i in range(n // 9 + j - 1))] if k % 2 else other[n // 5 + j - 1 :]
            docs.append((3 * k + j, " ".join(other)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: set(r["removed"]) for r in removed_lines(df, **how).collect()}
    want = brute_removed(docs)
    assert got == want and 25 < len(want) < 70


def test_postings_of_long_lines_of_frequent_words_stay_in_proportion(spark):
    from stratalens.llm.op02_line_dedup import BITS, ROW, line_rows, postings, word_parts
    from stratalens.llm.tokens import levels

    rng = random.Random(3)
    words_of = [f"word{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.sample(words_of, 1500))) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS th", "text")
    known = levels(df.select("text"), word_parts, BITS)
    nodes = line_rows(df, known, "prefix", 10).selectExpr("node", "n", "low", "high", "0 AS coarse", "prefix")
    posted = postings(nodes, 10)
    assert posted.count() * ROW.itemsize < 10 * sum(len(t) for _, t in docs)
    assert posted.groupBy("node").count().agg({"count": "min"}).first()[0] >= 301


@pytest.mark.parametrize("large, best, hubs, level", [(1024, 3, 64, 5), (4, 1, 2, 1), (10, 2, 3, 2000), (1, 1, 1, 2000)])
def test_meeting_loses_no_earlier_partner(large, best, hubs, level):
    from stratalens.llm.op02_line_dedup import _N, _POS, ROW, Meeting

    rng = np.random.default_rng(large)
    size = 400
    key, n, coarse = rng.integers(0, 30, size), rng.integers(8, 12, size), rng.integers(0, level, size)
    pos, bits = rng.integers(0, 3, size), np.int64(0b1111) ^ (np.int64(1) << rng.choice([0, 1, 2, 40, 62, 63], size))
    rows = np.zeros(size, ROW)
    half = np.where(rng.random(size) < 0.5, "low", "high")
    rows["low"], rows["high"] = np.where(half == "low", bits, 1), np.where(half == "low", 1, bits)
    rows["key"], rows["node"], rows["packed"] = key, np.arange(size), coarse << (_POS + _N) | n << _POS | pos
    by_node = rows.copy()
    rows = rows[np.lexsort((rows["packed"], rows["key"]))]
    meeting, wait, found, marked = Meeting(large, hubs, best), rows[:0], set(), set()
    for at in range(0, size, 7):
        wait, (x, y, d, more) = meeting.meet(np.concatenate([wait, rows[at : at + 7]]), at + 7 >= size)
        found |= {(a, b) for a, b, c in zip(x.tolist(), y.tolist(), d.tolist(), strict=True) if c >= 0}
        marked |= set(y[more].tolist())
    want = set()
    for i in range(size):
        for j in range(size):
            t = -(-80 * (n[i] + n[j]) // 180)
            differ = sum(bin(int(by_node[c][i] ^ by_node[c][j]) & (1 << 64) - 1).count("1") for c in ("low", "high"))
            if i != j and key[i] == key[j] and coarse[i] <= coarse[j] and 80 * max(n[i], n[j]) <= 100 * min(n[i], n[j]) and pos[i] < n[i] - t + 1 and pos[j] < n[j] - t + 1 and differ <= n[i] + n[j] - 2 * t:
                want.add((i, j))
    assert found <= want and {b for a, b in want - found} <= marked
    assert len(want) > 100


def test_asking_finds_the_nearest_partners_and_marks_others():
    from stratalens.llm.op02_line_dedup import _N, _POS, ROW, Asking

    rng = np.random.default_rng(5)
    size = 300
    rows = np.zeros(size, ROW)
    rows["key"], rows["node"], rows["high"] = np.sort(rng.integers(0, 9, size)), np.arange(size), np.int64(1) << rng.choice([0, 1, 2, 40, 62, 63], size)
    rows["packed"] = rng.integers(0, 40, size) << (_POS + _N) | 10 << _POS
    asks = rng.random(size) < 0.2
    both = np.concatenate([rows[asks], rows])
    flags = np.r_[np.ones(asks.sum(), bool), np.zeros(size, bool)]
    order = np.lexsort((both["packed"], ~flags, both["key"]))
    both, flags = both[order], flags[order]
    one, found = Asking(2), []
    for at in range(0, len(both), 11):
        found += one.add(both[at : at + 11], flags[at : at + 11])
    x, y, d, more = (np.concatenate(c) for c in zip(*(found + one.end()), strict=True))
    got = {}
    for a, b, c, m in zip(x.tolist(), y.tolist(), d.tolist(), more.tolist(), strict=True):
        got.setdefault(b, []).append((c, m, a))
    for j in np.flatnonzero(asks):
        level = rows["packed"] >> (_POS + _N)
        want = sorted(bin(int(rows["high"][i] ^ rows["high"][j]) & (1 << 64) - 1).count("1") for i in range(size) if i != j and rows["key"][i] == rows["key"][j] and level[i] <= level[j])
        mine = sorted(got.get(int(j), []))
        assert [c for c, _, _ in mine] == want[:3] and all(m == (len(want) > 2) for _, m, _ in mine) and len({a for _, _, a in mine}) == len(mine)


def test_lines_of_texts_over_a_block(spark):
    lines = [f"k{i} l{i} m{i} n{i} o{i}" for i in range(30_000)]
    for i in (12_000, 29_999):
        lines[i] = lines[i - 11_000]
    rows = [(1, "\n".join(lines)), (2, f"new words here\n{lines[20_000]}\n\n{lines[28_500]} z")]
    got = {r["doc_id"]: r["removed"] for r in removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows[0][1]) > 3 << 18 and got == {1: [12_000, 29_999], 2: [1, 3]}


def test_dedup_keeps_columns_and_null_texts(spark):
    rows = [(1, "a b c d e\nx", "q"), (2, "A b c d e\ny\n", "r"), (3, None, None), (2, "A b c d e\ny\n", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_lines(df).collect()), key=str)
    assert got == [(1, "a b c d e\nx", 0), (2, "y\n", 1), (2, "y\n", 1), (3, None, 0)]


def test_internal_names_never_meet_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 5, 6, 7, 8), (3, "p q", 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _th int, _removed int, _text int")
    more = df.selectExpr("*", "_id AS id_of", "_th AS hash_of", "_text AS hash_own", "_removed AS lines_of")
    kept = keep_one_of_each_class(more)
    assert kept.columns == more.columns and sorted(r["_text"] for r in kept.collect()) == [4, 9]
    got = dedup_lines(more)
    assert got.columns == [*more.columns, "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["id_of"], r["_removed"], r["n_removed"]) for r in got.collect()) == [(1, "a b c d e f", 1, 3, 0), (2, "", 5, 7, 1), (3, "p q", 9, 9, 0)]


@pytest.mark.parametrize("f", [lambda d: link_classes(d), lambda d: removed_lines(d), lambda d: keep_one_of_each_class(d)])
def test_empty_tables_give_no_rows(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_are_linked_by_their_own_texts(spark):
    docs = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (None, "a b c d e f")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in link_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1)]


def test_words_across_blocks(monkeypatch):
    from stratalens.llm import tokens

    text = "Ab  cd\n\n" * 500 + "é" * 700 + " end"
    column = pa.array([text, None, "", text.upper().replace("É", "é")])
    whole = {r: w.tolist() for r, w in words_by_row(column)}
    monkeypatch.setattr(tokens, "BLOCK", 64)
    assert {r: w.tolist() for r, w in words_by_row(column)} == whole and whole[0] == whole[3]
    assert len(whole[0]) == 1002 and len(set(whole[0])) == 4
    assert b"".join(bytes(d) for d, _, _ in blocks(pa.array([text]), at_lines=True)) == text.encode()


def test_shingles_of_short_texts_differ_from_longer_ones():
    w = np.arange(1, 9, dtype=np.uint64)
    assert len(shingles(w)) == 4 and len(shingles(w[:3])) == 1 and len(shingles(w[:0])) == 0
    assert shingles(w[:3])[0] != shingles(w[:4])[0]


def test_digest_ignores_order():
    keys = np.array([3, 9, 27], np.uint64)
    assert op03_ngram_join.digest(keys) == op03_ngram_join.digest(keys[::-1])


def nameless(seed):
    """A corpus in which about half of the rows have no id, some of them twice; and its texts under numbers that keep its order."""
    docs = [t for _, t in corpus(seed)]
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.5 else i, t) for i, t in enumerate(docs)]
    return rows + [r for r in rows if r[0] is None][:5]


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_without_ids_are_linked(spark, seed):
    rows = nameless(seed)
    numbered = [(i if i is not None else 1000 + k, t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: c if c < 1000 else None for i, c in brute_classes(numbered).items()}
    # a class of its own without words has no name but its id
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["n_shingles"]) for r in link_classes(df).collect())
    assert got == sorted((str(i if i < 1000 else None), str(want[i]), len(shingle_set(t))) for i, t in numbered)
    classes = {c for i, c in brute_classes(numbered).items() if shingle_set(dict(numbered)[i])}
    kept = keep_one_of_each_class(df).collect()
    assert sum(bool(shingle_set(r["text"])) for r in kept) == len(classes)


@pytest.mark.parametrize("seed", range(3))
def test_near_lines_of_rows_without_ids_are_removed(spark, seed):
    base = " ".join(f"b{i}" for i in range(10))
    near = base.replace("b3", "c3")
    extra = [(None, base + "\nx y z"), (5001, near), (5002, base.replace("b7", "d7"))]
    rows = nameless(seed) + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["th"]): set(r["removed"]) for r in removed_lines(df, **({} if seed % 2 else NARROW)).collect()}
    hashed = df.distinct().selectExpr("doc_id", "xxhash64(text) AS th", "text").filter("text IS NOT NULL").collect()
    placed = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["th"]), r["text"]) for r in hashed)
    want = {(k[1] if k[0] else None, k[2]): lines for k, lines in brute_removed(placed).items()}
    assert got == want
    assert {5001, 5002} <= {i for i, _ in got}


def test_rows_without_ids_bridge_classes(spark):
    def changed(name, *places):
        return " ".join(f"{name}x{k}" if k in places else f"{name}{k}" for k in range(100))

    rows = [(1, changed("a", 10, 30)), (None, changed("a")), (None, changed("a")), (2, changed("a", 50, 70)), (None, changed("b")), (None, changed("b", 20)), (None, changed("b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in link_classes(df).collect())
    assert got == sorted([("1", "1"), ("2", "1"), ("None", "1"), ("None", "1"), *[("None", "None")] * 3])
    assert sorted(r["text"][0] for r in keep_one_of_each_class(df).collect()) == ["a", "b"]


def test_groups_lose_no_earlier_partner_and_mark_by_key():
    from stratalens.llm.op02_line_dedup import _N, _POS, ROW, SHORT, Groups

    rng = np.random.default_rng(3)
    size = 600
    rows = np.zeros(size, ROW)
    rows["key"], rows["node"] = np.where(rng.random(size) < 0.3, 7, rng.integers(0, 40, size)), np.arange(size)
    n, coarse, pos = rng.integers(8, 12, size) + np.where(rng.random(size) < 0.1, SHORT, 0), rng.integers(0, 9, size), rng.integers(0, 3, size)
    rows["packed"], rows["low"] = coarse << (_POS + _N) | n << _POS | pos, np.int64(1) << rng.integers(0, 3, size)
    groups, found = Groups(10, 4, 2, most=50), []
    for at in range(0, size, 37):
        found += groups.add(rows[at : at + 37])
        assert groups.rows <= max(50, 40 * 11) + 37
    found += groups.end()
    got, marked = set(), set()
    for x, y, d, more, unsure, key in (z for part in found for z in zip(*(c.tolist() for c in part), strict=True)):
        assert key == rows["key"][y]
        if d >= 0:
            got.add((x, y))
            assert unsure == (coarse[x] == coarse[y] or min(n[x], n[y]) > SHORT)
        if more:
            marked.add(y)
    t = lambda i, j: -(-80 * (n[i] + n[j]) // 180)
    want = {(i, j) for i in range(size) for j in range(size) if i != j and rows["key"][i] == rows["key"][j] and coarse[i] <= coarse[j] and min(n[i] - pos[i], n[j] - pos[j]) >= t(i, j) and 2 * (rows["low"][i] != rows["low"][j]) <= n[i] + n[j] - 2 * t(i, j)}
    assert len(want) > 500 and got <= want and {y for _, y in want - got} <= marked


def test_equal_lines_of_one_block_have_one_first_row(spark):
    from stratalens.llm.op02_line_dedup import BITS, line_rows, word_parts
    from stratalens.llm.tokens import levels

    rows = [(3, "a b c d\nq r"), (None, "z\nD c b a"), (2, "a b c d\na b c d"), (2, "a b c d\na b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("doc_id", "xxhash64(text) AS th", "text")
    got = line_rows(df, levels(df.select("text"), word_parts, BITS), "prefix").collect()
    assert sorted((str(r["doc_id"]), r["line"]) for r in got if r["node"] is not None) == [("3", 1), ("None", 0), ("None", 1)]
    assert sorted((str(r["doc_id"]), r["line"]) for r in got if r["node"] is None) == [("2", 0), ("2", 0), ("2", 1), ("2", 1), ("3", 0)]
