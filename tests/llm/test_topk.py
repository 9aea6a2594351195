import math
import random
from collections import Counter

import pytest
from factmark.errors import ResearchError
from factmark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, block int"


def brute(rows, k, every):
    sound = []
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, [math.floor(256 * x) for x in v]))
    out = Counter()
    for own, (q, a) in enumerate(sound):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i)
                            for at, (i, b) in enumerate(sound) if at != own and len(a) == len(b))
            out.update((q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1))
    return out


def run(spark, rows, k=5, every=7):
    df = topk.top_k(topk.quantised(spark.createDataFrame(rows, SCHEMA)), k, every)
    return Counter(tuple(r) for r in df.collect())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "BITS", 4)
    r = random.Random(2)
    rows = [(i, [round(r.uniform(-2, 2), r.choice([1, 3])) for _ in range(4)], "", 0) for i in range(70)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], "", 0) for i in range(70, 110)]  # a vector many share
    rows += [(200, None, "", 0), (203, [], "", 0), (210, [1.0, None, 1.0, 1.0], "", 0),
             (217, [float("nan")] * 4, "", 0), (224, [float("inf"), 0.0, 0.0, 0.0], "", 0),
             (None, [1.0] * 4, "", 0), (231, [3.0, 4.0], "", 0), (232, [1.0, 1.0], "", 0),
             (238, [1.0], "", 0), (7, rows[7][1], "", 0), (14, [0.0] * 4, "", 0), (14, [9.0] * 4, "", 0), (15, [8.0] * 4, "", 0), (-7, [1.0] * 4, "", 0)]
    assert run(spark, rows) == brute(rows, 5, 7)


def test_few_candidates_and_an_empty_table(spark):
    rows = [(0, [1.0, 1.0], "", 0), (1, [1.0, 0.0], "", 0), (2, [0.0, -1.0], "", 0)]
    assert run(spark, rows) == brute(rows, 5, 7) and len(run(spark, rows)) == 2
    assert run(spark, [(0, [1.0], "", 0)]) == Counter()
    assert topk.top_k(topk.quantised(spark.createDataFrame([], SCHEMA))).collect() == []


def test_scores_past_64_bits_are_refused(spark):
    with pytest.raises(ResearchError):
        run(spark, [(0, [1e16, 1e16], "", 0), (1, [1e16, 1e16], "", 0)])
