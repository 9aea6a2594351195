"""Trade cost, borrow and capacity over tables of orders and instruments."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ResearchError
from ..functions.impact import (borrow_cost, borrow_refused, drag_coefficients, execution_cost,
                                net_sharpe)
from ..functions.normal import let

DRAG = ["_fixed", "_linear", "_power"]


def _market() -> dict[str, Column]:
    return dict(price=F.col("price"), adv=F.col("adv"), volatility=F.col("daily_volatility"),
                outstanding=F.col("shares_outstanding"), spread=F.col("spread"),
                commission=F.col("commission"))


def trade_costs(trades: DataFrame, instruments: DataFrame, days: float = 1.0) -> DataFrame:
    """Orders (symbol, shares) with every cost component as a column."""
    if days <= 0:
        raise ResearchError("an order needs a positive number of days")
    costs = execution_cost(F.col("shares"), **_market(), days=days)
    return _in_market(trades, instruments).select(
        *trades.columns, *[c.alias(name) for name, c in costs.items()])


def _in_market(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """Orders beside their instrument: a plain join with a dimension, whose hot symbols AQE
    splits. Orders without one are in ``unknown_instruments``."""
    return trades.join(instruments, "symbol")


def unknown_instruments(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """Orders that ``trade_costs`` and ``borrow_check`` cannot price, with the reason."""
    return trades.join(instruments.select("symbol"), "symbol", "left_anti").withColumn(
        "reason", F.when(F.col("symbol").isNull(), "order without a symbol")
        .otherwise("no such instrument"))


def borrow_decisions(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """Every position with ``refused``, and its ``borrow_fee`` where it is not.

    Borrow that is not there cannot be paid for: a larger short is refused, not priced.
    """
    market = instruments.select("symbol", "price", "borrow_available", "borrow_fee_annual")
    both = _in_market(trades, market)
    refused = F.coalesce(borrow_refused(F.col("shares"), F.col("borrow_available")), F.lit(False))
    fee = borrow_cost(F.col("shares"), F.col("price"), F.col("borrow_fee_annual"),
                      F.col("days_held"))
    return both.select(*trades.columns, "borrow_available", refused.alias("refused"),
                       F.when(~refused, fee).alias("borrow_fee"))


def borrow_check(trades: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions with their borrow fee, refused shorts). The two are filters of one plan:
    a caller that needs both takes ``borrow_decisions``."""
    decided = borrow_decisions(trades, instruments)
    return (decided.where(~F.col("refused")).select(*trades.columns, "borrow_fee"),
            decided.where("refused").select(*trades.columns, "borrow_available"))


def capacity(instruments: DataFrame, gross_sharpe: float, turnover_per_year: float,
             threshold: float = 0.5, trading_days: int = 252, days: float = 1.0,
             max_aum: float = 1e11, ratio: float = 1.0001) -> DataFrame:
    """The AUM at which costs leave ``threshold`` of the gross Sharpe, per instrument.

    Geometric bisection from [1, max_aum]; the bracket's log-width halves each
    round, so the number of rounds that reaches ``ratio`` is known in advance and the
    search is one fold over a short sequence. Infinite if the curve never crosses.
    """
    if gross_sharpe <= 0:
        raise ResearchError("gross_sharpe must be above zero for costs to halve it")
    if not 0 < threshold < 1:
        raise ResearchError("threshold is a share strictly between none and all")
    rounds = math.ceil(math.log2(math.log(max_aum) / math.log(ratio)))
    target = gross_sharpe * threshold

    def net(aum: Column) -> Column:
        return net_sharpe(aum, gross_sharpe, *(F.col(c) for c in DRAG))

    def halve(bracket: Column, _round: Column) -> Column:
        mid = F.sqrt(bracket["lo"] * bracket["hi"])
        return let(mid, lambda m: let(net(m) >= target, lambda enough: F.struct(
            F.when(enough, m).otherwise(bracket["lo"]).alias("lo"),
            F.when(enough, bracket["hi"]).otherwise(m).alias("hi"))))

    start = F.struct(F.lit(1.0).alias("lo"), F.lit(float(max_aum)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)["lo"]
    never = net(F.lit(float(max_aum))) >= target
    return _with_drag(instruments, turnover_per_year, trading_days, days).withColumn(
        "aum_ceiling", F.when(never, F.lit(float("inf"))).otherwise(found)).drop(*DRAG)


def capacity_curve(ceilings: DataFrame, gross_sharpe: float, turnover_per_year: float,
                   trading_days: int = 252, days: float = 1.0,
                   max_aum: float = 1e11) -> DataFrame:
    """Net Sharpe over decades of AUM from 1e5 up to 100 times each finite ceiling."""
    decades = [10.0 ** e for e in range(5, int(math.log10(max_aum)) + 1)]
    finite = ceilings.where(F.col("aum_ceiling") < float("inf"))
    curve = (_with_drag(finite, turnover_per_year, trading_days, days)
             .withColumn("aum", F.explode(F.array(*[F.lit(d) for d in decades])))
             .where(F.col("aum") <= F.least(F.col("aum_ceiling") * 100, F.lit(float(max_aum)))))
    return curve.select("symbol", "aum", net_sharpe(
        F.col("aum"), gross_sharpe, *(F.col(c) for c in DRAG)).alias("net_sharpe"))


def _with_drag(instruments: DataFrame, turnover_per_year: float, trading_days: int,
               days: float) -> DataFrame:
    parts = drag_coefficients(**_market(), turnover_per_year=turnover_per_year,
                              trading_days=trading_days, days=days)
    return instruments.withColumns({f"_{name}": c for name, c in parts.items()})
