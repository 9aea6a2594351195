"""Small per-row formulas shared by the operators."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def size_factor(market_cap: Column) -> Column:
    """Log market capitalisation; NULL where there is no positive cap to log."""
    return F.when(market_cap > 0, F.log(market_cap))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` with NULL for a zero divisor."""
    return top / F.nullif(bottom, F.lit(0.0))


def annualise_return(total: Column, horizon: Column,
                     trading_days: int = TRADING_DAYS) -> Column:
    """(1 + total) ** (periods per year / horizon) - 1, floored at total loss."""
    growth = F.greatest(1.0 + total, F.lit(0.0))
    return F.when(growth > 0, F.pow(growth, trading_days / horizon.cast("double"))
                  ).otherwise(0.0) - 1.0


def annualise_volatility(per_period: Column, trading_days: int = TRADING_DAYS) -> Column:
    return per_period * math.sqrt(trading_days)


def throttle(drawdown: Column, limit: float, floor: float = 0.0) -> Column:
    """Share of target risk to keep at a positive ``drawdown``."""
    return F.greatest(F.lit(float(floor)), 1.0 - drawdown / float(limit))


def recovery_time(drawdown: Column, expected_return: float) -> Column:
    """Periods of compounding at ``expected_return`` needed to regain the peak."""
    if expected_return <= 0:
        return F.lit(float("inf"))
    return (F.when(drawdown == 0, 0.0)
            .when(drawdown >= 1, F.lit(float("inf")))
            .otherwise(-F.log1p(-drawdown) / math.log1p(expected_return)))


def required_text(column: Column, shortest: int = 1) -> Column:
    """True for text that still has ``shortest`` characters once trimmed."""
    return F.coalesce(F.length(F.trim(column)) >= shortest, F.lit(False))
