"""Selection-bias statistics of Bailey and Lopez de Prado as Columns."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import let, norm_cdf, norm_ppfs

EULER_MASCHERONI = 0.5772156649015329
# An absolute per-period Sharpe above this is an annualised figure by mistake.
PLAUSIBLE_PER_PERIOD_SHARPE = 1.0


def unit_expected_max(n_trials: Column) -> Column:
    """Expected best of ``n_trials`` standard normal draws; zero when there is one."""
    n = n_trials.cast("double")
    tails = norm_ppfs(1.0 - 1.0 / n, 1.0 - math.exp(-1.0) / n)
    spread = let(tails, lambda z: (1.0 - EULER_MASCHERONI) * z[0] + EULER_MASCHERONI * z[1])
    return F.when(n == 1, 0.0).when(n > 0, spread)


def expected_max_sharpe(n_trials: Column, var_trials: Column, mean_trials: float = 0.0) -> Column:
    """Expected best Sharpe of ``n_trials`` draws; the mean itself when there is one."""
    return scaled_expected_max(unit_expected_max(n_trials), var_trials, mean_trials)


def scaled_expected_max(unit: Column, var_trials: Column, mean_trials: float = 0.0) -> Column:
    return F.when(var_trials >= 0, unit * F.sqrt(var_trials) + mean_trials)


def deflated_sharpe(observed: Column, n_trials: Column, sample_length: Column,
                    skewness: Column, kurtosis: Column, var_trials: Column) -> Column:
    """Probability that the true Sharpe beats what selection alone would give.

    ``kurtosis`` is not excess. NULL wherever the published formula is undefined
    or the Sharpe is implausible as a per-period figure.
    """
    return deflated_against(observed, expected_max_sharpe(n_trials, var_trials), sample_length,
                            skewness, kurtosis)


def deflated_against(observed: Column, bar: Column, sample_length: Column,
                     skewness: Column, kurtosis: Column) -> Column:
    """``deflated_sharpe`` given the expected maximum already at hand."""
    adjust = 1.0 - skewness * observed + (kurtosis - 1.0) / 4.0 * observed * observed
    usable = ((F.abs(observed) <= PLAUSIBLE_PER_PERIOD_SHARPE)
              & (sample_length > 1) & (adjust > 0))
    z = F.when(usable, (observed - bar) * F.sqrt(sample_length.cast("double") - 1.0)
               / F.sqrt(adjust))
    return norm_cdf(z)


def min_backtest_length(observed: Column, n_trials: Column) -> Column:
    """Periods needed before ``observed`` stops being explainable by search size."""
    return length_against(observed, unit_expected_max(n_trials))


def length_against(observed: Column, unit: Column) -> Column:
    return F.when(observed > 0, (unit / observed) * (unit / observed))


def verdict(deflated: Column, sample_length: Column, min_length: Column,
            threshold: float = 0.95) -> Column:
    """Significant at ``threshold`` and long enough; false when undefined."""
    return F.coalesce((deflated >= threshold) & (sample_length >= min_length), F.lit(False))


def plausible_per_period(sharpe: Column) -> Column:
    """Unit guard: false for figures that are almost surely annualised."""
    return F.abs(sharpe) <= PLAUSIBLE_PER_PERIOD_SHARPE
