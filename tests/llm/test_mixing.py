import random
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import numpy as np
import pytest
from factmark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, target string, n_chars long"


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.targets([1, 1, 40], [1, 2, 3]) == [3, 3, 36]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([0, 6], [2, 1]) == [0, 6]


def test_apportionment_equals_giving_seats_one_by_one():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 8)
        votes = [r.choice([0, 1, 3, 3, 7, r.randint(0, 50), r.random() * 9]) for _ in range(n)]
        most = [r.choice([3, 10, 10**6]) for _ in range(n)]
        seats, out = r.randint(0, 60), [0] * n
        for _ in range(seats):
            free = [i for i in range(n) if out[i] < most[i] and votes[i] > 0]
            if not free:
                break
            out[max(free, key=lambda i: (Fraction(votes[i]) / (2 * out[i] + 1), -i))] += 1
        if sum(out) == seats:
            got = mixing.apportion(np.array(votes, float), seats, np.array(most))
            assert got.tolist() == out, (votes, most, seats)


@pytest.fixture
def docs(spark):
    r, v = random.Random(8), brute.vocabulary(50)
    rows = []
    for i in range(240):
        source = "big" if i % 3 == 0 else r.choice(["a", "é", "Z", None, "tiny"] if i < 40 else ["a", "Z", None])
        size = r.choice([0, 1, 7, 60, 300])
        rows.append((i, " ".join(r.choice(v) for _ in range(size)) or r.choice([None, "", " "]),
                     "xx", source, "clash", 1))
    rows += [(5, "same row", "xx", "a", "", 1)] * 3 + [(None, "no id here", "xx", None, "", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("laid_out", [10, 10**6])
def test_sources_come_near_their_targets(spark, docs, monkeypatch, laid_out):
    monkeypatch.setattr(mixing, "LAID_OUT", laid_out)
    rows = docs.collect()
    out = mixing.mix(docs, carry=["source"]).collect()
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter(
        (r["doc_id"], len(brute.words(r["text"]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]),
                      strict=True))
    taken, lines = Counter(), defaultdict(list)
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    shards = 1 + len(rows) // laid_out
    for s in order:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK * (1 + shards), s
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in out)


def test_copies_hold_the_words_that_are_taken(spark, docs):
    want, whole = Counter(), defaultdict(set)
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["taken"]
    for r in docs.collect():
        whole[r["doc_id"]].add(r["text"])
    got = Counter()
    for r in mixing.mixed_copies(docs).collect():
        got[r["doc_id"]] += len(brute.words(r["text"]))
        own = [brute.words(t) for t in whole[r["doc_id"]]]
        assert any(set(brute.words(r["text"])) <= set(w) for w in own)
        assert r["n_chars"] == len(r["text"])
    assert +want == +got


def test_copies_are_whole_but_at_the_ends_of_a_run(spark):
    """Unequal sources, one below its size: no text may hold words that did not follow each other."""
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(20 + i)), "xx", "big" if i % 3 else "small", "", 1)
            for i in range(150)] + [(999, " ".join(f"d999w{j}" for j in range(4000)), "xx", "one", "", 1)]
    whole = {r[0]: r[1].split() for r in rows}
    source = {r[0]: r[3] for r in rows}
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = mixing.mixed_copies(docs).collect()
    cut, got = Counter(), Counter()
    for r in texts:
        w = r["text"].split()
        at = whole[r["doc_id"]].index(w[0])
        assert w == whole[r["doc_id"]][at:at + len(w)]
        cut[source[r["doc_id"]]] += len(w) < len(whole[r["doc_id"]])
        got[r["doc_id"]] += len(w)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    assert got == want and max(cut.values()) <= 2
    assert any(n < len(whole[i]) for i, n in want.items()) and set(whole) - set(want)


@pytest.mark.parametrize("seed", range(4))
def test_a_gap_in_a_document_makes_two_rows(spark, seed):
    """One document in its shard: the run may leave out its middle."""
    rows = [(1, " ".join(f"a{j}" for j in range(1000)), "xx", "a", "", 1),
            (2, " ".join(f"b{j}" for j in range(1000)), "xx", "b", "", 1)]
    for r in mixing.mixed_copies(spark.createDataFrame(rows, SCHEMA), (1, 3), seed=seed).collect():
        w = [int(x[1:]) for x in r["text"].split()]
        assert w == list(range(w[0], w[0] + len(w)))


def test_empty_table(spark, docs):
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mixed_copies(docs.limit(0)).collect() == []
