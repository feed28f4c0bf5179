"""The registered corpus queries against their SQL on sf0.001, and the pipeline against brute force stage by stage."""

import pytest
from conftest import DATA, same_as_sql

from stratalens.llm import queries as corpus
from stratalens.llm.common import is_held_out, table


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    same_as_sql(spark, duck, corpus.queries()[name], corpus.oracle_sql()[name])


def test_language_of_held_out_documents(spark):
    found = {r["doc_id"]: r for r in corpus.queries()["op6_language"](spark, DATA).collect()}
    docs = table(spark, DATA, "documents").collect()
    assert len(found) == len(docs)
    assert all(found[d["doc_id"]]["held_out"] == is_held_out(d["doc_id"]) for d in docs)
    held = [d for d in docs if is_held_out(d["doc_id"])]
    assert sum(found[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in found.values()) <= 0.02 * len(docs)


def test_toxicity_separates_labels(spark):
    found = {r["doc_id"]: r for r in corpus.queries()["op1_toxicity"](spark, DATA).collect()}
    labels = table(spark, DATA, "labels").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    held = [x for x in labels if is_held_out(x["doc_id"])]
    toxic = [found[x["doc_id"]]["score"] for x in held if x["toxic"]]
    clean = [found[x["doc_id"]]["score"] for x in held if not x["toxic"]]
    assert toxic and clean
    better = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert better > 0.8


def test_pipeline_stages_do_what_they_say(spark):
    import corpus_pipeline
    from test_sets import brute_classes, brute_removed, shingle_set

    docs = table(spark, DATA, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], DATA)
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    raw, languages, lines, unique, clean = ([r.asDict() for r in k.collect()] for k in kept)
    assert {d["doc_id"] for d in languages} <= {d["doc_id"] for d in raw} and len(languages) >= 0.98 * len(raw)
    removed = brute_removed([(d["doc_id"], d["text"]) for d in languages])
    want = {}
    for d in languages:
        gone = removed.get(d["doc_id"], set())
        text = "\n".join(x for i, x in enumerate(d["text"].split("\n")) if i not in gone)
        if not gone or text.strip():
            want[d["doc_id"]] = text
    assert {d["doc_id"]: d["text"] for d in lines} == want
    assert all(d["n_chars"] == len(d["text"]) for d in lines)
    classes = brute_classes([(d["doc_id"], d["text"]) for d in lines])
    assert sorted(d["doc_id"] for d in unique) == sorted({c if shingle_set(want[i]) else i for i, c in classes.items()})
    gone = {r["doc_id"] for r in corpus.op10_decontaminate.decontaminate(kept[3], table(spark, DATA, "benchmark")).filter("contaminated").collect()}
    assert sorted(d["doc_id"] for d in clean) == sorted(d["doc_id"] for d in unique if d["doc_id"] not in gone)
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], DATA).collect()
    assert len(last) == len(clean) and all(len(r["ids_bytes"]) == 4 * r["n_tokens"] for r in last)


ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, None, "en", "s", 0), (2, "the cat sat on the mat", "en", "s", 3), (2, "the cat sat on the mat", "en", "s", 3), (None, "the cat sat on the mat", None, None, 7), (3, "123 456", "de", None, None), (4, "word " * 30_000, "en", "t", 1)]


def test_stages_take_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(*r, "mine", 9) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, n_removed string, node int")
    want = {
        "language_id": None,  # the model of so few rows tells little
        "line_dedup": sorted([(None, None), (1, ""), (1, None), (None, "the cat sat on the mat"), (3, "123 456"), (4, "word " * 30_000)], key=str),
        # null ids come first; a null text counts as empty, so one of (1, null) and (1, "") stays
        "ngram_join": sorted([(None, ""), (1, ""), (None, "the cat sat on the mat"), (3, "123 456"), (4, "word " * 30_000)], key=str),
        "decontaminate": sorted([(r[0], r[1]) for r in ODD], key=str),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == corpus_pipeline.COLUMNS, name
        got = sorted([(r["doc_id"], (r["text"] or "") if name == "ngram_join" else r["text"]) for r in out.collect()], key=str)
        if want[name] is not None:
            assert got == want[name], name
        assert name == "ngram_join" or set(got) <= {(r[0], r[1]) for r in ODD}
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(ids) == len(ODD) and all(len(r["ids_bytes"]) == 4 * r["n_tokens"] for r in ids)


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0, name
