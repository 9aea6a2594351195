"""Purge, embargo and leak counts against a plain implementation and published figures."""
import random

import pytest
from pyspark.sql import functions as F

from helpers import day
from factmark.errors import LeakageError, ResearchError
from factmark.operators import folds
from factmark.plans import research


def labels_of(spark, ends, start="2000-01-01"):
    base = day(start).toordinal()
    rows = [("s", i, day(start).fromordinal(base + a), day(start).fromordinal(base + b))
            for i, (a, b) in enumerate(ends)]
    return spark.createDataFrame(rows, "series_id string, idx long, t0 date, t1 date")


@pytest.mark.parametrize("horizon", [1, 10, 25, 50])
def test_published_leak_counts(spark, horizon):
    labels = labels_of(spark, [(i, i + horizon) for i in range(1000)])
    row = folds.leakage_report(labels).first()
    assert row.observations == 1000
    assert row.would_leak_under_naive_kfold == 8 * horizon
    assert row.leak_rate_naive == pytest.approx(8 * horizon / 5000)


def test_leakage_by_horizon_is_one_job(spark):
    labels = labels_of(spark, [(i, i) for i in range(1000)])
    rows = research.leakage_by_horizon(labels, [1, 50]).collect()
    assert {r.horizon: r.would_leak_under_naive_kfold for r in rows} == {1: 8, 50: 400}


def plain_roles(ends, k, pct):
    """(fold, idx) -> role by direct reading of the definitions."""
    n, out, at = len(ends), {}, 0
    for fold in range(k):
        size = n // k + (fold < n % k)
        test = range(at, at + size)
        at += size
        lo, hi = min(ends[i][0] for i in test), max(ends[i][1] for i in test)
        for i in range(n):
            inside = ends[i][0] <= hi and ends[i][1] >= lo
            near = test[-1] < i <= test[-1] + int(n * pct)
            out[fold, i] = ("test" if i in test else "purged" if inside
                            else "embargoed" if near else "train")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_roles_match_the_definitions(spark, seed):
    rng = random.Random(seed)
    n, k, pct = rng.randint(20, 90), rng.randint(2, 6), rng.choice([0.0, 0.05, 0.2])
    starts = sorted(rng.randint(0, 200) for _ in range(n))
    ends = [(a, a + rng.randint(0, 15)) for a in starts]
    got = folds.purged_folds(labels_of(spark, ends), k, pct).collect()
    assert {(r.fold, r.idx): r.role for r in got} == plain_roles(ends, k, pct)


def test_leakage_is_found_in_naive_folds_only(spark):
    labels = labels_of(spark, [(i, i + 5) for i in range(100)])
    purged = folds.purged_folds(labels)
    folds.assert_no_leakage(purged, labels)
    naive = purged.withColumn("role", F.when(F.col("role") == "test", "test").otherwise("train"))
    assert folds.leakage(naive, labels).agg(F.sum("leaking_rows")).first()[0] == 40
    with pytest.raises(LeakageError):
        folds.assert_no_leakage(naive, labels)


def test_unusable_labels_are_named(spark):
    labels = labels_of(spark, [(0, 5), (3, 2), (1, 4)])
    reasons = {r.reason: r.rows for r in folds.label_problems(labels, 5).collect()}
    assert reasons == {"label ends before it starts": 1, "fewer rows than folds": 3,
                       "t0 is not ascending": 1}
    with pytest.raises(ResearchError):
        folds.purged_folds(labels, 1)
    with pytest.raises(ResearchError):
        folds.fold_bounds(labels, 2, 0.5)


def test_folds_without_training_rows_are_unusable(spark):
    labels = labels_of(spark, [(i, i + 100) for i in range(10)])
    sizes = folds.fold_sizes(folds.purged_folds(labels, 2)).collect()
    assert not any(r.usable for r in sizes)


def test_lookahead_audit(spark):
    decisions = spark.createDataFrame([(1, 10, 2), (2, 10, 2), (3, 10, 1), (4, 10, 0)],
                                      "decision_id int, ts long, delivered long")
    inputs = spark.createDataFrame([(1, 9), (1, 10), (2, 11), (3, 1), (3, 2)],
                                   "decision_id int, ts long")
    rows = {r.decision_id: (r.future_visible, r.extra_visible)
            for r in folds.lookahead_audit(decisions, inputs).collect()}
    assert rows == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False)}


def test_bad_series_are_refused_whole_and_nothing_is_lost(spark):
    rows = [("good", i, day(f"2020-01-{i + 1:02d}"), day(f"2020-01-{i + 3:02d}")) for i in range(12)]
    rows += [("back", i, day(f"2020-01-{i + 2:02d}"), day("2020-01-01")) for i in range(12)]
    rows += [("mixed", i, day(f"2020-01-{20 - i:02d}"), day("2020-02-01")) for i in range(12)]
    rows += [("short", 0, day("2020-01-01"), day("2020-01-02"))]
    labels = spark.createDataFrame(rows, "series_id string, idx long, t0 date, t1 date")
    good, refused = folds.split_labels(labels, 5)
    assert {r.series_id for r in good.collect()} == {"good"}
    assert {r.series_id: list(r.reasons) for r in refused.collect()} == {
        "back": ["label ends before it starts"], "mixed": ["t0 is not ascending"],
        "short": ["fewer rows than folds"]}
    assert good.count() + refused.count() == len(rows)


def test_refused_series_are_returned_with_their_reasons(spark):
    good = labels_of(spark, [(i, i + 1) for i in range(20)])
    named = lambda ends, name: labels_of(spark, ends).withColumn("series_id", F.lit(name))
    odd = named([(0, 1), (3, 2), (2, 4), (5, 6), (6, 7)], "odd").unionByName(
        named([(0, 1)], "short")).unionByName(named([(0, 90), (1, 91), (2, 92), (3, 93)], "long"))
    split, refused = folds.checked_folds(good.unionByName(odd), 2)
    reasons = {r.series_id: r.reasons for r in refused.collect()}
    assert set(reasons) == {"odd", "short", "long"}
    assert len(reasons["odd"]) == 2 and reasons["long"] == ["nothing to train on in fold 0, 1"]
    assert {r.series_id for r in split.select("series_id").distinct().collect()} == {"s"}
    purged = folds.purged_folds(good, 2, roles=("purged",)).collect()
    whole = folds.purged_folds(good, 2).where("role = 'purged'").collect()
    assert sorted(purged) == sorted(whole) and purged
