"""The corpus pipeline: every stage's decisions on its own input."""

from test_pair_ops import brute_components
from test_texts_ops import tokens

import corpus_pipeline
from tagloom.llm.common import QUERIES, table
from tagloom.session import materialize

FOLDER = "/root/testdata/sf0.01"


def contaminated(text, windows):
    words = tokens(text)
    return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))


def test_stages_decide_as_their_operators(spark):
    docs = table(spark, FOLDER, "documents")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r.doc_id: r.text for r in docs.collect()} if name != "quality" else None
        columns = docs.columns
        docs = materialize(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0
    predicted = {r.doc_id for r in QUERIES["op4_histogram_boosted_quality"](spark, FOLDER).filter("predicted = 1").collect()}
    assert set(inputs["line_dedup"]) == predicted
    good = {r.doc_id for r in table(spark, FOLDER, "labels").filter("quality = 1").collect()}
    assert len(good - predicted) <= 0.01 * len(good)
    # lines only ever go, and a document goes only if nothing is left of it
    for doc, text in inputs["near_copies"].items():
        whole = iter(inputs["line_dedup"][doc].split("\n"))
        assert all(line in whole for line in text.split("\n")) or not text
    want = {i for i, _, c in brute_components(list(inputs["near_copies"].items()), 5, 80, 100) if i == c}
    assert set(inputs["decontaminate"]) == want
    windows = set()
    for r in table(spark, FOLDER, "benchmark").collect():
        w = tokens(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    assert set(inputs["packing"]) == {i for i, t in inputs["decontaminate"].items() if not contaminated(t, windows)}
    assert {r.doc_id for r in docs.collect()} == set(inputs["packing"])


def test_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, _all string, _row int, removed_lines int"
    prose = ["The same plain words of prose are here, and more of them follow.\nAnother line of many words stands below the first one here."]
    rows = [(i, t, "en", "s", 3, "x", 1, 2) for i, t in enumerate([None, "", " \n ", *prose * 3, "short"])] + [(None, "no id", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = {r.doc_id for r in out.collect()}
        assert {None, 0, 1, 2, 3, 6} <= kept
        assert (5 in kept) == (name == "decontaminate")
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, FOLDER).collect()} == {None, *range(7)}
    assert corpus_pipeline.quality(spark, docs.limit(0), FOLDER).collect() == []
