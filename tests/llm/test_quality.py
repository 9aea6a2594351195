import zlib

import numpy as np
import pyarrow as pa
import pytest
from factmark.llm import quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score double, held_out string"


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    for r in rows:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from factmark.llm.labels import held_out
    from pyspark.sql import functions as F
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality"))
                              .otherwise(F.col("quality")))
    a, b = (quality.train(docs, x) for x in (labels, other))
    assert all((p == q).all() for p, q in zip(a.tables, b.tables, strict=True))


def test_odd_texts_have_defined_scores(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (None, "a b c"), (10**6 + 3, "w " * 100_000)]
    docs = train.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr(
        "doc_id", "text", "1D score", "'x' held_out")
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert got[10**6] == got[10**6 + 1] == got[10**6 + 2]
    assert all(0 <= got[i] <= 1 for i, _ in odd)


def test_no_labels_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 0.0, "")], SCHEMA)
    none = spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, quality int")
    row = quality.quality(docs, none).first()
    assert row["score"] == pytest.approx(1, abs=1e-5) and row["predicted"] == 1
    assert quality.quality(docs.limit(0), none).collect() == []


def test_the_sample_is_bounded(spark):
    from factmark.llm import labels as L
    many = spark.range(20_000).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    assert 800 < L.sample(many, "quality", 1000).count() < 1200
    assert L.sample(many.limit(50), "quality", 1000).count() <= 50


def test_features_by_hand():
    x = quality.features(pa.array(["AB ab ab | x!!\nAB ab", None]))
    got = dict(zip(quality.FEATURES, x[0], strict=True))
    assert got["words"] == pytest.approx(np.log1p(7))
    assert got["distinct"] == pytest.approx(4 / 7) and got["commonest"] == pytest.approx(3 / 7)
    assert got["stuttered"] == pytest.approx(1 / 7) and got["shouted"] == pytest.approx(2 / 7)
    assert got["again_2"] == pytest.approx(4 / 7) and got["bare_symbols"] == pytest.approx(1 / 7)
    assert (x[1] == 0).all()


def test_a_tree_takes_the_best_cut():
    g, h = np.array([1.0, 2, -3, -4, 5]), np.ones(5)
    step = quality._tree(g, h)
    best = max(range(1, 5), key=lambda c: g[:c].sum() ** 2 / (c + quality.SMOOTH)
               + g[c:].sum() ** 2 / (5 - c + quality.SMOOTH))
    assert step[best - 1] != step[best] and len(set(step)) == 3


def test_a_pair_is_learned_that_no_feature_shows_alone():
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=60)
    assert (0, 1) in model.pairs
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.9
