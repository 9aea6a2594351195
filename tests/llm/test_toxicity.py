import numpy as np
import pyarrow as pa
from factmark.llm import text, toxicity

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score double, m string"


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    assert len(toxic) > 80
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.01 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_odd_texts_no_labels_and_an_empty_table(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (5, None)],
                                   "doc_id long, toxic int")
    rows = [(i, f"some plain words {i} " + ("you rotter!" if i % 2 else "my friend"), 0.0, "") for i in range(80)]
    rows += [(100, None, 0.0, ""), (101, "", 0.0, ""), (None, "ROTTER, he said", 0.0, ""),
             (102, "w " * 50_000 + "rotter", 0.0, ""), (102, "w " * 50_000 + "rotter", 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    assert got[100]["score"] == got[101]["score"] < 0.3
    assert got[None]["predicted"] == 1 and got[102]["predicted"] == 1
    assert all(got[i]["predicted"] == i % 2 for i in range(80))
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_copies_of_one_document_make_no_terms(spark):
    copy = "quite an unusual sentence with a peculiar word in it for once"
    rows = [(i, copy + f" {i % 3}", 1) for i in range(60)] + [
        (100 + i, f"number {i} of many different plain texts on {i * i} things {i * 7} rotter", i % 2)
        for i in range(60)]
    docs = spark.createDataFrame([(i, t if y or i < 100 else t.replace(" rotter", "")) for i, t, y in rows],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    terms = {t for _, t in toxicity.train(docs, labels).lexicon.terms}
    assert any("rotter".startswith(t) for t in terms)
    assert not any("peculiar".startswith(t) for t in terms)


def test_hits_by_hand():
    lexicon = toxicity.Lexicon([(4, "rott"), (0, "bad")], [0.9, 0.9], 0.1)
    hits = lexicon.hits(text.words(pa.array(["Rotten, bad! badly rot", None, "BAD bad"])))
    assert hits.tolist() == [[1, 1], [0, 0], [0, 2]]


def test_the_label_model_finds_who_is_right():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    def voter(accuracy, speaks):
        right = r.random(len(y)) < accuracy
        return np.where(r.random(len(y)) < speaks, np.where(y == right, 1, -1), 0)
    own = voter(0.85, 0.6)
    v = np.column_stack([voter(0.95, 0.5), voter(0.8, 0.7), voter(0.6, 0.8), own, own, own])
    model = toxicity.fit_labels(v, np.full(6, 0.75), 0.3)
    assert abs(model.accuracy[:4] - [0.95, 0.8, 0.6, 0.85]).max() < 0.1
    assert model.source[3] == model.source[4] == model.source[5] and len(set(model.source)) == 4
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.85


def test_the_linear_classifier_solves_its_equations():
    r = np.random.default_rng(2)
    x = np.column_stack([np.ones(500), r.normal(size=(500, 3))])
    p = 1 / (1 + np.exp(-(x @ [0.5, 1, -2, 0])))
    beta = toxicity.fit_linear(x, p)
    q = 1 / (1 + np.exp(-(x @ beta)))
    slope = x.T @ (p - q) - np.array([1e-6, 1, 1, 1]) * beta
    assert abs(slope).max() < 1e-6
