"""Distributed positions, quantiles and summary joins against brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmark.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of the rows, one value with half of them."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"g{i % 17}", i,
             0.0 if rng.random() < 0.5 else round(rng.uniform(-5, 5), 2)) for i in range(6000)]
    return spark.createDataFrame(rows, "g string, id long, v double").repartition(8), rows


def test_positions_match_a_sort(skewed):
    df, rows = skewed
    got = {r.id: (r.position, r.n) for r in ordering.with_position(
        df, ["v", "id"], ["g"], size="n").collect()}
    for group in {g for g, _, _ in rows}:
        members = sorted((v, i) for g, i, v in rows if g == group)
        assert [got[i] for _, i in members] == [(k, len(members)) for k in range(len(members))]


def test_positions_without_groups_spread_over_tasks(skewed):
    df, rows = skewed
    out = ordering.with_position(df, ["v", "id"])
    order = [r.id for r in out.orderBy("position").collect()]
    assert order == [i for _, i in sorted((v, i) for _, i, v in rows)]


def test_weighted_positions_count_copies(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 5), (3.0, 1)], "v double, w long")
    rows = ordering.with_position(df, ["v"], size="n", weight="w").orderBy("v").collect()
    assert [(r.position, r.n) for r in rows] == [(0, 9), (3, 9), (8, 9)]


@pytest.mark.parametrize("group", [[], ["g"]])
def test_quantiles_match_numpy(skewed, group):
    df, rows = skewed
    probs = [0.0, 0.01, 0.05, 0.37, 0.5, 0.95, 1.0]
    got = {(r["g"] if group else None, r.probability): r.quantile
           for r in ordering.exact_quantiles(df, "v", probs, group).collect()}
    names = {g for g, _, _ in rows} if group else {None}
    assert len(got) == len(names) * len(probs)
    for name in names:
        values = [v for g, _, v in rows if name in (None, g)]
        for p in probs:
            assert got[name, p] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_quantiles_are_narrowed_in_rounds(spark, monkeypatch, group):
    monkeypatch.setattr(ordering, "SORTED", 3)
    monkeypatch.setattr(ordering, "CELLS", 16)
    rng = random.Random(3)
    spread = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(120)]
    close = [1.0 + i * 2.0**-50 for i in range(60)] + [5.0] * 60
    rows = [("spread", v, rng.randrange(4)) for v in spread] + [("close", v, 1) for v in close]
    df = spark.createDataFrame([*rows, ("none", None, 1), ("nan", float("nan"), 2)], "g string, v double, w int")
    probs = [0.0, 0.13, 0.5, 0.77, 1.0]
    got = {(r["g"] if group else None, r.probability): r.quantile
           for r in ordering.exact_quantiles(df, "v", probs, group, "w").collect()}
    names = {"spread", "close"} if group else {None}
    assert {n for n, _ in got} == names
    for name in names:
        values = [v for g, v, w in rows if name in (None, g) for _ in range(w)]
        for p in probs:
            low, high = np.percentile(values, 100 * p, method="lower"), np.percentile(values, 100 * p, method="higher")
            at = p * (len(values) - 1)
            assert got[name, p] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)


def test_sketched_quantiles_keep_their_rank(skewed):
    df, rows = skewed
    for g, names in (([], {None}), (["g"], {g for g, _, _ in rows})):
        for r in ordering.approximate_quantiles(df, "v", [0.1, 0.9], g, 500).collect():
            values = sorted(v for n, _, v in rows if not g or n == r["g"])
            low, high = np.searchsorted(values, [r.quantile] * 2, "left"), np.searchsorted(values, r.quantile, "right")
            slack = len(values) / 500 + 1
            assert low[0] - slack <= r.probability * len(values) <= high + slack
        assert names


def test_quantile_of_one_value(spark):
    df = spark.createDataFrame([(4.0,)], "v double")
    assert {r.quantile for r in ordering.exact_quantiles(df, "v", [0.05, 0.5]).collect()} == {4.0}


@pytest.mark.parametrize("n, k", [(7, 5), (10, 5), (12, 5), (5, 5), (1003, 7)])
def test_folds_match_array_split(spark, n, k):
    rows = spark.range(n).select("id", ordering.fold_of(F.col("id"), F.lit(n), k).alias("f"))
    want = [f for f, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert [r.f for r in rows.orderBy("id").collect()] == want
