"""Closed forms and published worked examples of the Column functions."""
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from factmark.functions import deflation, impact, scalars, sizing
from factmark.functions.normal import erf, norm_cdf, norm_ppf


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*values):
    return [F.lit(v) for v in values]


def test_normal_functions_match_the_standard_library(spark):
    xs = [-30.0, -6.5, -4.0, -1.0, -0.47, 0.0, 1e-9, 0.46875, 0.5, 2.0, 3.99, 4.01, 6.0, 28.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", erf(F.col("x")).alias("e"), norm_cdf(F.col("x")).alias("c")).collect()
    for r in rows:
        assert r.e == pytest.approx(math.erf(r.x), abs=1e-15)
        assert r.c == pytest.approx(NormalDist().cdf(r.x), abs=1e-15)
    ps = [1e-300, 1e-10, 0.01, 0.075, 0.3, 0.5, 0.925, 0.9999, 1 - 1e-12]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select(
            "p", norm_ppf(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-13)
    assert value(spark, norm_ppf(F.lit(0.0))) is None
    assert value(spark, norm_ppf(F.lit(1.0))) is None


def test_published_selection_bias_examples(spark):
    assert value(spark, deflation.expected_max_sharpe(*lit(100, 0.5 / 250))) == pytest.approx(
        0.1132, abs=5e-5)
    assert value(spark, deflation.expected_max_sharpe(*lit(1000, 1.0))) == pytest.approx(
        3.26, abs=0.01)
    assert value(spark, deflation.deflated_sharpe(
        *lit(2.5 / math.sqrt(250), 100, 1250, -3.0, 10.0, 0.5 / 250))) == pytest.approx(
        0.9004, abs=5e-5)
    assert value(spark, deflation.min_backtest_length(*lit(1.0, 45))) == pytest.approx(5.0, abs=0.01)


@pytest.mark.parametrize("n, expected", [(10, 0.8220), (100, 0.7251), (1000, 0.6375),
                                         (5000, 0.5811)])
def test_deflation_falls_with_the_trial_count(spark, n, expected):
    got = value(spark, deflation.deflated_sharpe(*lit(0.0413, n, 1250, 0.0, 3.0, 9.258e-05)))
    assert got == pytest.approx(expected, abs=5e-4)


def test_undefined_deflations_are_null(spark):
    assert value(spark, deflation.deflated_sharpe(*lit(1.5, 10, 100, 0.0, 3.0, 0.01))) is None
    assert value(spark, deflation.deflated_sharpe(*lit(0.1, 10, 1, 0.0, 3.0, 0.01))) is None
    assert value(spark, deflation.min_backtest_length(*lit(-0.1, 10))) is None
    assert value(spark, deflation.expected_max_sharpe(*lit(1, 0.5))) == 0.0
    assert value(spark, deflation.expected_max_sharpe(*lit(10, -1.0))) is None


def _market(adv, outstanding):
    return dict(price=F.lit(50.0), adv=F.lit(float(adv)), volatility=F.lit(0.02),
                outstanding=F.lit(float(outstanding)), spread=F.lit(0.0005),
                commission=F.lit(0.0005))


@pytest.mark.parametrize("adv, outstanding, bps, rate", [(10e6, 1e9, 10.3, 0.01),
                                                         (1e5, 1e7, 135.2, 1.0)])
def test_published_cost_of_100k_shares(spark, adv, outstanding, bps, rate):
    cost = impact.execution_cost(F.lit(100_000), **_market(adv, outstanding))
    assert value(spark, cost["total_bps"]) == pytest.approx(bps, abs=0.05)
    assert value(spark, cost["participation_rate"]) == pytest.approx(rate)


def test_impact_exponents_and_signs(spark):
    at = lambda n: value(spark, impact.temporary_impact(
        F.lit(float(n)), F.lit(1e7), F.lit(0.02)))
    assert at(200_000) / at(100_000) == pytest.approx(2 ** 0.6)
    assert at(-100_000) == -at(100_000)
    perm = lambda n: value(spark, impact.permanent_impact(
        F.lit(float(n)), F.lit(1e7), F.lit(0.02), F.lit(1e9)))
    assert perm(200_000) / perm(100_000) == pytest.approx(2.0)
    nothing = impact.execution_cost(F.lit(0), **_market(1e7, 1e9))
    assert {value(spark, c) for c in nothing.values()} == {0.0}


def test_kelly_and_growth(spark):
    assert value(spark, sizing.kelly_fraction(*lit(0.6, 1.0))) == pytest.approx(0.2)
    assert value(spark, sizing.kelly_fraction(*lit(0.3, 1.0))) == pytest.approx(-0.4)
    assert value(spark, sizing.kelly_fraction(*lit(1.2, 1.0))) is None
    assert value(spark, sizing.growth_rate(*lit(1.0, 0.6, 1.0))) == -math.inf
    assert value(spark, sizing.growth_rate(*lit(0.5, 1.0, 2.0))) == pytest.approx(math.log(2.0))
    assert value(spark, sizing.growth_rate(*lit(0.2, 0.6, 1.0))) == pytest.approx(
        0.6 * math.log(1.2) + 0.4 * math.log(0.8))


def test_scalar_formulas(spark):
    assert value(spark, scalars.recovery_time(F.lit(0.5), 0.10)) == pytest.approx(7.273, abs=5e-4)
    assert value(spark, scalars.recovery_time(F.lit(1.0), 0.10)) == math.inf
    assert value(spark, scalars.recovery_time(F.lit(0.0), 0.10)) == 0.0
    assert value(spark, scalars.recovery_time(F.lit(0.2), 0.0)) == math.inf
    assert value(spark, scalars.throttle(F.lit(0.1), 0.2)) == pytest.approx(0.5)
    assert value(spark, scalars.throttle(F.lit(0.9), 0.2, 0.25)) == 0.25
    assert value(spark, scalars.annualise_return(*lit(0.10, 126))) == pytest.approx(1.1 ** 2 - 1)
    assert value(spark, scalars.annualise_return(*lit(-1.5, 126))) == -1.0
    assert value(spark, scalars.size_factor(F.lit(0.0))) is None
    assert value(spark, scalars.required_text(F.lit("  short  "), 10)) is False
