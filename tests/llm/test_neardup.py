import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from factmark.llm import neardup
from factmark.session import Scratch

SCHEMA = "doc_id long, text string, component_id string, bucket int"


def check(spark, docs, width, percent):
    rows = [(d, t, "x", 1) for d, t in docs]
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3),
                                  width, percent).collect()
    want = brute.near_components([x for x in docs if x[0] is not None], width, percent)
    assert len(out) == len(docs)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    return out


@pytest.mark.parametrize(("width", "percent", "hubs"), [(3, 85, 1), (5, 80, 4)])
def test_families_of_copies_of_copies(spark, monkeypatch, width, percent, hubs):
    monkeypatch.setattr(neardup, "HUBS", hubs)
    texts = []
    for s in range(5):
        texts += brute.family(s, 14, 50 + 30 * s, 2 + s)
    texts += ["", None, " ", "One", "one", "one two", "ONE two", "one two three", "É x", "é x"]
    random.Random(0).shuffle(texts)
    check(spark, list(enumerate(texts)), width, percent)


def test_a_chain_in_which_only_neighbours_are_alike(spark):
    w = brute.vocabulary(400, 9)
    check(spark, [(i, " ".join(w[3 * i:3 * i + 60])) for i in range(30)], 3, 85)


def test_a_hub_that_holds_more_than_its_members(spark):
    w = brute.vocabulary(300, 4)
    docs = [(0, " ".join(w[:90]))] + [(i, " ".join(w[:72 + i % 4])) for i in range(1, 12)]
    check(spark, docs, 3, 85)


def test_exact_copies_nulls_and_repeated_rows(spark):
    text = "a text that a third of all rows hold word for word"
    docs = [(i, text if i % 3 else f"text {i} of its own kind and no other {i * 7}") for i in range(60)]
    out = check(spark, [*docs, (None, text), (None, "alone without an id")], 3, 85)
    nulls = [r for r in out if r["doc_id"] is None]
    assert sorted((r["component_id"] is None, r["kept"]) for r in nulls) == [(False, False), (True, True)]
    twice = neardup.near_duplicates(spark.createDataFrame([(1, text, "", 0)] * 3, SCHEMA)).collect()
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in twice] == [(1, 1, True)] * 3


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_agree_about_as_often_as_sets_overlap():
    a, b = (" ".join(f"w{i}" for i in range(x, x + 400)) for x in (0, 40))
    found, owner = neardup.shingles(pa.array([a, b, "few words here", "few words here now"]), 1)
    sig = neardup.signatures(found, owner, 4, 512)
    assert abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.07
    assert abs((sig[2] == sig[3]).mean() - 3 / 4) < 0.1  # most bins are filled from others
    assert len(np.unique(sig[2])) == 3


def test_components_are_closed(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 60), (50, 70)],
                                  "a long, b long")
    with Scratch(spark, "test") as scratch:
        got = {r["node"]: r["component"]
               for r in neardup.components(links, scratch, 4).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {50: 50, 60: 50, 70: 50}
