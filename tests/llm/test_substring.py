import random

import brute
import pytest
from factmark.llm import substring

SCHEMA = "doc_id long, text string, lang string, block long, n_words string"


def check(spark, docs, n):
    rows = [(d, t, f"l{i}", i, "x") for i, (d, t) in enumerate(docs)]
    out = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), n,
                                   carry=["lang", "block", "n_words"]).collect()
    got = {r["lang"]: r for r in out}
    assert len(out) == len(docs)
    for i, ((d, t), kept) in enumerate(zip(docs, brute.remove_repeats(docs, n), strict=True)):
        r, w = got[f"l{i}"], brute.words(t)
        assert (r["doc_id"], r["block"]) == (d, i)
        assert r["kept_words"] == " ".join(kept)
        assert (r["n_words"], r["n_removed"]) == (len(w), len(w) - len(kept))
        assert r["text"] == (t if len(kept) == len(w) else " ".join(kept))
        left = list(w)
        for a, b in reversed(r["spans"]):
            del left[a:b]
        assert left == kept
        assert all(x[1] < y[0] for x, y in zip(r["spans"][:-1], r["spans"][1:], strict=True))


@pytest.mark.parametrize("block", [200, 10**6])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring, "RANGE_WINDOWS", block)
    r, v = random.Random(3), brute.vocabulary(200)
    passages = [" ".join(r.choice(v) for _ in range(r.randint(4, 12))) for _ in range(6)]
    docs = [(i, "\n".join(r.choice([r.choice(passages), " ".join(r.choice(v) for _ in range(8))])
                          for _ in range(r.randint(1, 6)))) for i in range(40)]
    docs += [(None, docs[0][1]), (None, "only here " + passages[0]), (5, docs[7][1]), (5, docs[5][1]),
             (50, None), (51, ""), (52, " \n "), (53, "short one"), (54, docs[3][1]), (55, docs[3][1]),
             (56, "a a a a a a a a a a"), (57, "a a a a a a")]
    r.shuffle(docs)
    check(spark, docs, 5)


def test_a_third_of_all_rows_are_copies(spark):
    docs = [(i, "the very same words in every copy of it" if i % 3 == 0 else f"own {i} words " * 4)
            for i in range(90)]
    check(spark, docs, 4)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
