"""Costs, borrow, capacity; trial, holdout and run ledgers; fingerprints."""
import math

import pytest
from pyspark.sql import functions as F

from helpers import day
from factmark.errors import ResearchError
from factmark.functions.impact import execution_cost
from factmark.operators import costs, fingerprint, ledger, validation
from factmark.schemas import INSTRUMENTS


@pytest.fixture(scope="module")
def market(spark):
    return spark.createDataFrame([
        ("BIG", 50.0, 1e7, 0.02, 1e9, 0.0005, 0.0005, 5e6, 0.005),
        ("SMALL", 50.0, 1e5, 0.02, 1e7, 0.0005, 0.0005, 0.0, 0.0)], INSTRUMENTS)


def test_published_capacity(market):
    rows = {r.symbol: r.aum_ceiling for r in costs.capacity(market, 2.0, 12.0).collect()}
    assert rows["BIG"] / 1e6 == pytest.approx(22_446, abs=1.5)
    assert rows["SMALL"] / 1e6 == pytest.approx(224, abs=0.5)


def test_capacity_curve_falls_and_stops(market):
    ceilings = costs.capacity(market, 2.0, 12.0)
    curve = costs.capacity_curve(ceilings, 2.0, 12.0).where("symbol = 'SMALL'").orderBy("aum").collect()
    values = [r.net_sharpe for r in curve]
    assert values == sorted(values, reverse=True)
    assert [r.aum for r in curve] == [1e5, 1e6, 1e7, 1e8, 1e9, 1e10]
    # The ceiling priced order by order: half of the gross Sharpe is left.
    aum = F.col("aum_ceiling")
    cost = execution_cost(aum * 12 / 252 / F.col("price"), F.col("price"), F.col("adv"),
                          F.col("daily_volatility"), F.col("shares_outstanding"), F.col("spread"),
                          F.col("commission"))["total"]
    left = 2.0 - cost / aum * 252 / (F.col("daily_volatility") * math.sqrt(252))
    assert [r.s for r in ceilings.select(left.alias("s")).collect()] == pytest.approx(
        [1.0, 1.0], abs=1e-3)


def test_capacity_limits(market):
    assert {r.aum_ceiling for r in costs.capacity(market, 50.0, 0.01).collect()} == {math.inf}
    for bad in ({"gross_sharpe": 0.0}, {"gross_sharpe": 1.0, "threshold": 1.0}):
        with pytest.raises(ResearchError):
            costs.capacity(market, turnover_per_year=12.0, **bad)


def test_unborrowable_shorts_are_refused(spark, market):
    orders = spark.createDataFrame([("BIG", -1e6, 365), ("BIG", -6e6, 10), ("SMALL", -1.0, 1),
                                    ("SMALL", 5.0, 9)], "symbol string, shares double, days_held int")
    held, refused = costs.borrow_check(orders, market)
    assert {(r.symbol, r.shares): r.borrow_fee for r in held.collect()} == {
        ("BIG", -1e6): pytest.approx(1e6 * 50 * 0.005), ("SMALL", 5.0): 0.0}
    assert {(r.symbol, r.shares) for r in refused.collect()} == {("BIG", -6e6), ("SMALL", -1.0)}
    with pytest.raises(ResearchError):
        costs.trade_costs(orders, market, days=0)


def test_instruments_are_validated(market):
    good, bad = validation.split_instruments(market.withColumn(
        "adv", F.when(F.col("symbol") == "BIG", 0.0).otherwise(F.col("adv"))))
    assert [r.symbol for r in good.collect()] == ["SMALL"]
    assert [r.reason for r in bad.collect()] == ["adv must be positive"]


TRIALS = "trial_id string, dataset_id string, search_id string, sharpe double"


def test_every_trial_counts_reported_or_not(spark):
    trials = spark.createDataFrame([("1", "d", "s", 0.1), ("2", "d", "s", None), ("3", "d", "t", None),
                                    ("4", "e", "t", 0.3), ("5", "e", "t", 0.1)], TRIALS)
    rows = {r.dataset_id: r for r in ledger.deflation_inputs(trials).collect()}
    assert (rows["d"].n_trials, rows["d"].trials_without_outcome) == (3, 2)
    assert rows["d"].var_trials is None and rows["e"].var_trials == pytest.approx(0.02)
    assert {r.search_id: r.n_trials for r in ledger.trial_counts(trials, "search_id").collect()} == {
        "s": 2, "t": 3}


def test_deflation_needs_a_variance(spark):
    cols = ("observed_sharpe double, n_trials long, sample_length long, skew double, "
            "kurtosis double, var_trials double")
    rows = ledger.deflated_results(spark.createDataFrame([
        (0.1, 10, 1000, 0.0, 3.0, None), (0.1, 10, 1000, 0.0, 3.0, 0.0),
        (-0.1, 10, 1000, 0.0, 3.0, 0.01), (0.09, 1, 5000, 0.0, 3.0, 0.01)], cols)).collect()
    assert [r.deflated_sharpe is None for r in rows] == [True, True, False, False]
    assert rows[2].min_backtest_length is None and not rows[2].significant
    assert rows[3].significant and rows[3].min_backtest_length == 0.0


def test_annualised_figures_are_caught(spark):
    trials = spark.createDataFrame([("1", "d", "s", 1.5), ("2", "d", "s", -2.0), ("3", "d", "s", 0.9),
                                    ("4", "d", "s", None)], TRIALS)
    assert {r.trial_id for r in ledger.implausible_sharpes(trials).collect()} == {"1", "2"}


def test_broken_trial_logs(spark):
    log = spark.createDataFrame([
        ("ok", "started", "d", "s"), ("ok", "outcome", "d", "s"), ("quiet", "started", "d", "s"),
        ("twice", "started", "d", "s"), ("twice", "outcome", "d", "s"), ("twice", "outcome", "d", "s"),
        ("orphan", "outcome", "d", "s"), ("moved", "started", "d", "s"), ("moved", "outcome", "e", "s")],
        "trial_id string, kind string, dataset_id string, search_id string")
    assert {(r.trial_id, r.rule) for r in ledger.trial_violations(log).collect()} == {
        ("twice", "second outcome"), ("orphan", "outcome without start"), ("moved", "changed identity")}


def test_broken_run_and_holdout_records(spark):
    runs = spark.createDataFrame([("a", "started", "x", None), ("a", "finished", "x", "h1"),
                                  ("b", "started", "x", None), ("b", "finished", "y", "h1"),
                                  ("b", "finished", "x", "h2"), ("c", "finished", "x", "h")],
                                 "run_id string, kind string, identity string, result_hash string")
    assert {(r.run_id, r.rule) for r in ledger.run_violations(runs).collect()} == {
        ("b", "changed identity"), ("b", "result rewritten"), ("c", "result without start")}
    periods = spark.createDataFrame([("d", day("2020-01-01"), day("2020-02-01"))] * 2 + [
        ("e", day("2020-01-01"), day("2020-02-01")), ("e", day("2020-01-01"), day("2020-03-01"))],
        "dataset_id string, start_date date, end_date date")
    promises = spark.createDataFrame([("r1", "d", "f", "h", "up"), ("r1", "d", "f", "h", "down"),
                                      ("r2", "d", "f", "h", "up")],
                                     "registration_id string, dataset_id string, "
                                     "strategy_family string, hypothesis string, expected_result string")
    assert {(r.key, r.rule) for r in ledger.holdout_violations(periods, promises).collect()} == {
        ("e", "second holdout period"), ("r1", "edited registration")}


@pytest.mark.parametrize("start, end, refused", [
    ("2022-06-01", "2023-01-01", True), ("2024-12-31", "2025-06-01", True),
    ("2023-06-01", "2023-07-01", True), ("2020-01-01", "2026-01-01", True),
    ("2015-01-01", "2022-12-31", False), ("2025-01-01", "2025-02-01", False)])
def test_holdout_overlap_is_inclusive(spark, start, end, refused):
    held = spark.createDataFrame([("sp500", day("2023-01-01"), day("2024-12-31"))],
                                 "dataset_id string, start_date date, end_date date")
    asked = spark.createDataFrame([("sp500", day(start), day(end)), ("other", day(start), day(end))],
                                  held.schema)
    rows = {r.dataset_id: r.refused for r in ledger.overlapping_requests(asked, held).collect()}
    assert rows == {"sp500": refused, "other": False}
    good, bad = validation.split_holdouts(held.selectExpr(
        "dataset_id", "end_date AS start_date", "start_date AS end_date"))
    assert (good.count(), bad.count()) == (0, 1)


def test_exhaustion_tiers_and_evaluation_audit(spark):
    looks = spark.createDataFrame([("d", f, f"{f}{i % 2}") for f, n in (("a", 1), ("b", 3), ("c", 4))
                                   for i in range(n)],
                                  "dataset_id string, strategy_family string, registration_id string")
    rows = {r.strategy_family: (r.evaluations, r.exhausted, r.warning)
            for r in ledger.holdout_exhaustion(looks).collect()}
    assert rows == {"a": (1, False, "none"), "b": (3, True, "caution"), "c": (4, True, "exhausted")}
    known = spark.createDataFrame([("a0",), ("b0",), ("c0",)], "registration_id string")
    missing = ledger.unregistered_evaluations(looks, known)
    assert {r.registration_id for r in missing.collect()} == {"b1", "c1"}
    assert {r.registration_id: r.looks for r in ledger.double_spent(looks).collect()} == {
        "b0": 2, "c0": 2, "c1": 2}


def test_registrations_must_predict(spark):
    rows = spark.createDataFrame([("f", "h", "Sharpe above 0.4"), ("f", "h", "we will see"[:6]),
                                  (" ", "h", "Sharpe above 0.4"), ("f", None, "Sharpe above 0.4")],
                                 "strategy_family string, hypothesis string, expected_result string")
    good, bad = validation.split_registrations(rows)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == [
        "expected_result is not falsifiable", "hypothesis is required", "strategy_family is required"]


def test_run_search_and_records(spark):
    runs = spark.createDataFrame([
        ("1", "mom", ["momentum", "size"], "2024-01-01 00:00:00", "completed"),
        ("2", "mom", ["momentum2"], "2024-02-01 00:00:00", "completed"),
        ("3", "rev", ["momentum"], "2024-03-01 00:00:00", "failed")],
        "run_id string, strategy string, factors array<string>, started_at string, outcome string"
    ).withColumn("started_at", F.col("started_at").cast("timestamp"))
    ids = lambda **kw: [r.run_id for r in ledger.search_runs(runs, **kw).collect()]
    assert ids() == ["1", "2", "3"] and ids(strategy="mom") == ["1", "2"]
    assert ids(factor="momentum") == ["1", "3"] and ids(outcome="failed") == ["3"]
    assert ids(since="2024-01-15 00:00:00", until="2024-02-15 00:00:00") == ["2"]
    assert [r.run_id for r in ledger.records(runs, "started_at", run_id="2").collect()] == ["2"]


def test_fingerprints(spark):
    rows = [("a", 1.0), ("b", 2.0), ("b", 2.0), (None, None)]
    df = spark.createDataFrame(rows, "k string, v double")
    mark = lambda d, **kw: fingerprint.fingerprint(d, **kw).first().content_hash
    assert mark(df) == mark(df.repartition(5).select("v", "k"))
    assert mark(df) != mark(df.distinct())
    assert mark(df) != mark(df.withColumn("v", F.col("v") + 1e-12))
    assert mark(df, digits=10) == mark(df.withColumn("v", F.col("v") + 1e-12), digits=10)
    recorded = fingerprint.fingerprint(df, ["k"])
    again = fingerprint.fingerprint(df.where("k = 'a'"), ["k"])
    rows = {r.k: r.reproduced for r in fingerprint.replay_check(recorded, again, ["k"]).collect()}
    assert rows == {"a": True, "b": False, None: False}


def test_orders_without_an_instrument_are_set_aside(spark):
    market = spark.createDataFrame([("A", 50.0, 1e6, 0.02, 1e8, 5e6, 0.01, 0.01, 0.0)], INSTRUMENTS) \
        if len(INSTRUMENTS.fields) == 9 else None
    orders = spark.createDataFrame([("A", 10.0), ("Z", 5.0), (None, 1.0)], "symbol string, shares double")
    instruments = spark.createDataFrame([("A",)], "symbol string") if market is None else market
    lost = costs.unknown_instruments(orders, instruments)
    assert {(r.symbol, r.reason) for r in lost.collect()} == {
        ("Z", "no such instrument"), (None, "order without a symbol")}
    assert orders.join(instruments, "symbol").count() + lost.count() == orders.count()
