"""Drawdowns, risk metrics, path statistics, sizing."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmark.operators import allocation, factors, risk


def column(df, name):
    return [r[name] for r in df.orderBy("effective_date").collect()]


def test_drawdown_by_hand(panel_of):
    falls = risk.drawdown_series(panel_of(a=[100, 120, 90, 150]))
    assert column(falls, "drawdown") == pytest.approx([0, 0, -0.25, 0])
    control = risk.risk_controls(falls, 0.5, 0.1).where("drawdown < 0").first()
    assert control.keep == pytest.approx(0.5)
    assert control.recovery == pytest.approx(-math.log(0.75) / math.log(1.1))


def test_unusable_curves_are_refused(panel_of):
    curves = panel_of(ok=[1, 2, 3], ruined=[1, 0, 0], negative=[1, -1, 1], born_dead=[0, 1, 1],
                      nan=[1, float("nan"), 1])
    good, bad = risk.split_equity(curves)
    assert {r.entity_id for r in bad.collect()} == {"ruined", "negative", "born_dead", "nan"}
    assert {r.entity_id for r in good.collect()} == {"ok"}
    _, bad = risk.split_equity(curves, allow_ruin=True)
    assert {r.entity_id for r in bad.collect()} == {"negative", "born_dead", "nan"}


def test_risk_metrics_match_numpy(panel_of):
    rng = np.random.default_rng(3)
    prices = 100 * np.cumprod(1 + rng.normal(0.001, 0.02, 300))
    row = risk.risk_metrics(panel_of(a=prices)).first()
    r = np.diff(prices) / prices[:-1]
    fall = prices / np.maximum.accumulate(prices) - 1
    assert row.n_observations == 299
    assert row.max_drawdown == pytest.approx(-fall.min())
    assert row.ulcer_index == pytest.approx(100 * np.sqrt(np.mean(fall ** 2)))
    assert row.volatility_annualised == pytest.approx(r.std(ddof=1) * math.sqrt(252))
    assert row.sharpe_per_period == pytest.approx(r.mean() / r.std(ddof=1))
    assert row.var_95 == pytest.approx(-np.percentile(r, 5))
    assert row.var_99 == pytest.approx(-np.percentile(r, 1))


def test_degenerate_curves(panel_of):
    rows = {r.entity_id: r for r in risk.risk_metrics(panel_of(
        flat=[5] * 10, growth=[100 * 1.01 ** i for i in range(10)], short=[1, 2])).collect()}
    assert rows["flat"].sharpe_per_period == 0.0 and rows["flat"].var_95 == 0.0
    assert rows["growth"].sharpe_annualised == math.inf
    assert "short" not in rows


def test_sharpe_differences_before_dropping(panel_of):
    gap = [100, 101, float("nan"), 200, 202, 203]
    rows = {r.entity_id: r for r in risk.per_period_sharpe(panel_of(
        gap=gap, flat=[1, 1, 1, 1], tiny=[1, 2])).collect()}
    r = np.array([0.01, 0.01, 203 / 202 - 1])
    assert rows["gap"].n == 3 and rows["gap"].sharpe == pytest.approx(r.mean() / r.std(ddof=1))
    assert rows["flat"].sharpe == 0.0 == rows["tiny"].sharpe


def _outcomes(spark, terminal, horizon):
    return spark.createDataFrame([(str(i), t / 100 - 1, horizon, 0.0, t <= 0)
                                  for i, t in enumerate(terminal)],
                                 "path_id string, total_return double, horizon int, "
                                 "max_drawdown double, ruined boolean")


def test_path_statistics_by_hand(spark):
    row = risk.path_statistics(_outcomes(spark, [120.0, 100.0, 80.0, 150.0, 90.0], 252)).first()
    assert row.n_paths == 5 and row.probability_of_loss == pytest.approx(0.4)
    assert row.best_terminal_return == pytest.approx(0.5)
    assert row.worst_terminal_return == pytest.approx(-0.2)
    half = risk.path_statistics(_outcomes(spark, [110.0], 126)).first()
    assert half.mean_annualised_return == pytest.approx(1.1 ** 2 - 1)
    assert half.terminal_dispersion == 0.0


def test_path_statistics_match_numpy(spark):
    rng = np.random.default_rng(1)
    paths = 100 * np.cumprod(np.hstack([np.ones((40, 1)), 1 + rng.normal(0, 0.05, (40, 30))]), 1)
    paths[0, 5:] = 0.0
    rows = [(str(i), j, float(v)) for i, p in enumerate(paths) for j, v in enumerate(p)]
    frame = spark.createDataFrame(rows, "path_id string, step int, value double")
    got = risk.path_statistics(risk.path_outcomes(frame, 100.0)).first()
    total = paths[:, -1] / 100 - 1
    fall = (paths / np.maximum.accumulate(paths, axis=1) - 1).min(axis=1)
    q = np.percentile(total, 5)
    annual = np.maximum(1 + total, 0) ** (252 / 30) - 1
    assert got.var_95 == pytest.approx(-q) and got.ruin_probability == pytest.approx(1 / 40)
    assert got.expected_shortfall_95 == pytest.approx(-total[total <= q].mean())
    assert got.max_drawdown_95 == pytest.approx(np.percentile(-fall, 95))
    assert got.median_annualised_return == pytest.approx(np.median(annual))
    assert got.terminal_dispersion == pytest.approx(annual.std(ddof=1))


def test_pooled_var_matches_numpy(panel_of):
    prices = [100, 90, 95, 80, 120, 121, 119]
    returns = factors.simple_returns(panel_of(a=prices))
    got = {r.confidence: r["var"] for r in risk.historical_var(returns, [0.95, 0.99]).collect()}
    r = np.diff(prices) / np.array(prices[:-1])
    assert got == pytest.approx({0.95: -np.percentile(r, 5), 0.99: -np.percentile(r, 1)})


def _asset_returns(spark, x, names, portfolio="p"):
    import datetime
    base = datetime.date(2020, 1, 1)
    rows = [(portfolio, n, base + datetime.timedelta(days=i), float(v))
            for i, line in enumerate(x) for n, v in zip(names, line)]
    return spark.createDataFrame(
        rows, "portfolio_id string, entity_id string, effective_date date, ret double")


def test_kelly_weights_match_numpy(spark):
    x = np.random.default_rng(5).normal([0.001, 0.0005, 0.0], [0.01, 0.02, 0.03], (200, 3))
    returns = _asset_returns(spark, x, "abc")
    # A date on which one asset did not trade is not used.
    partial = _asset_returns(spark, [[9.0]], ["a"]).withColumn(
        "effective_date", F.lit("2030-01-01").cast("date"))
    moments = allocation.return_moments(returns.unionByName(partial), 0.0001)
    row = moments.first()
    assert row.n_dates == 200 and row.status == "solved"
    want = np.linalg.solve(np.cov(x, rowvar=False), x.mean(axis=0) - 0.0001)
    assert row.weights == pytest.approx(want)
    half = {r.entity_id: r for r in allocation.kelly_weights(moments, 0.5).collect()}
    assert half["a"].weight == pytest.approx(want[0] / 2)
    assert half["a"].cash_weight == pytest.approx(1 - want.sum() / 2)
    assert half["a"].gross_leverage == pytest.approx(np.abs(want).sum() / 2)
    assert half["a"].is_levered == (1 - want.sum() / 2 < 0)


def test_dependent_assets_have_no_weights(spark):
    x = np.random.default_rng(5).normal(0, 0.01, (50, 1))
    twin = allocation.return_moments(_asset_returns(spark, np.hstack([x, 0 * x]), "ab"))
    assert [r.status for r in twin.collect()] == ["singular"]
    wide = np.random.default_rng(6).normal(0, 0.01, (4, 30))  # more assets than dates
    names = [f"n{i}" for i in range(30)]
    moments = allocation.return_moments(_asset_returns(spark, wide, names)).first()
    assert (moments.status, moments.n_dates, len(moments["mean"])) == ("singular", 4, 30)
    one = allocation.return_moments(_asset_returns(spark, x[:1], "a"))
    assert [r.status for r in one.collect()] == ["fewer than two dates"]
    assert allocation.kelly_weights(twin).count() == 0


def test_scenarios_keep_weights_and_square_the_multiplier(spark):
    x = np.random.default_rng(5).normal(0.001, 0.01, (100, 2))
    moments = allocation.return_moments(_asset_returns(spark, x, "ab"))
    w = np.linalg.solve(np.cov(x, rowvar=False), x.mean(axis=0)) / 2
    rows = {r.scenario: r for r in allocation.scenario_shocks(moments).collect()}
    sd = math.sqrt(w @ np.cov(x, rowvar=False) @ w)
    assert rows["market_crash"].mean_return == pytest.approx(-2 * w @ x.mean(axis=0))
    assert rows["market_crash"].volatility == pytest.approx(3 * sd)
    assert len(rows) == allocation.scenarios(spark).count() == 4


def test_wide_portfolios_by_gradient_equal_the_dense_solution(spark):
    r = np.random.default_rng(11)
    scale = np.array([0.001, 0.01, 0.02, 0.3, 0.05, 0.004])
    x = (r.normal(size=(60, 6)) @ (np.eye(6) + 0.4 * r.normal(size=(6, 6)))) * scale + 0.01 * scale
    twin = np.hstack([x[:, :3], x[:, :1]])
    returns = _asset_returns(spark, x, "abcdef").unionByName(
        _asset_returns(spark, twin, "abcd", "twin")).unionByName(
        _asset_returns(spark, x[:2, :3], "abc", "two dates")).unionByName(
        _asset_returns(spark, x[:1, :1], "a", "one date"))
    holed = returns.where("NOT (entity_id = 'b' AND effective_date = DATE '2020-01-09')")
    for rows in (returns, holed):
        want = {m.portfolio_id: m for m in allocation.return_moments(rows, 0.0001).collect()}
        got = {m.portfolio_id: m for m in allocation.return_moments(rows, 0.0001, dense=0).collect()}
        assert got["p"].status == want["p"].status == "solved" and got["p"].covariance is None
        assert got["p"].assets == want["p"].assets and got["p"].n_dates == want["p"].n_dates
        assert np.allclose(got["p"].weights, want["p"].weights, rtol=1e-9, atol=0)
        assert got["p"].variance == pytest.approx(want["p"].variance, rel=1e-9)
        assert got["twin"].status == "singular" and got["twin"].weights is None
        # Three assets on two dates: singular by rank, no matrix is built.
        assert (want["two dates"].status, want["two dates"].covariance) == ("singular", None)
        assert want["one date"].status == "fewer than two dates"


def test_bet_log_kelly(spark):
    bets = spark.createDataFrame([("s", True, 2.0)] * 6 + [("s", False, 1.0)] * 4
                                 + [("t", True, 1.0)], "strategy string, win boolean, amount double")
    rows = {r.strategy: r for r in allocation.bet_kelly(bets).collect()}
    assert rows["s"].kelly == pytest.approx((2 * 0.6 - 0.4) / 2)
    assert rows["s"].fractional_kelly == pytest.approx(0.2)
    assert rows["t"].kelly is None
