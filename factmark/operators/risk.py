"""Drawdown, risk and path-outcome statistics, per entity or per set of paths."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import TRADING_DAYS, annualise_return, finite, recovery_time, throttle
from ..session import materialise
from .ordering import exact_quantiles, one_row


def _running(key: str, order: str):
    return W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def split_equity(equity: DataFrame, allow_ruin: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable curves, refused entities): finite, not negative, starting above zero."""
    too_low = F.col("value") < 0 if allow_ruin else F.col("value") <= 0
    per = equity.groupBy("entity_id").agg(
        F.min_by("value", "effective_date").alias("_first"),
        F.max((too_low | ~finite(F.col("value"))).cast("int")).alias("_bad"))
    refused = per.where((F.col("_bad") == 1) | (F.col("_first") <= 0)).select("entity_id")
    return equity.join(refused, "entity_id", "left_anti"), refused


def drawdown_series(equity: DataFrame, key: str = "entity_id",
                    order: str = "effective_date", value: str = "value") -> DataFrame:
    """Signed fractional fall from the running peak (zero or negative)."""
    return equity.withColumn(
        "drawdown", F.col(value) / F.max(value).over(_running(key, order)) - 1)


def risk_controls(drawdowns: DataFrame, limit: float, expected_return: float,
                  floor: float = 0.0) -> DataFrame:
    """Exposure to keep and time to recover at each point of a drawdown frame."""
    depth = -F.col("drawdown")
    return (drawdowns.withColumn("keep", throttle(depth, limit, floor))
            .withColumn("recovery", recovery_time(depth, expected_return)))


def floored_var(returns: Column, confidence: float) -> Column:
    """Positive loss at the (1 - confidence) quantile, zero when there is none.

    ``percentile`` keeps the group's distinct values: one per calendar day here.
    For groups without that bound use ``historical_var``.
    """
    return F.greatest(F.lit(0.0), -F.percentile(returns, F.lit(1.0 - confidence)))


def historical_var(returns: DataFrame, confidences: list[float],
                   group: list[str] = (), ret: str = "ret") -> DataFrame:
    """Exact VaR of arbitrarily large groups by distributed ranking."""
    tails = exact_quantiles(returns, ret, [1.0 - c for c in confidences], group)
    return tails.select(*group, F.round(1 - F.col("probability"), 12).alias("confidence"),
                        F.greatest(F.lit(0.0), -F.col("quantile")).alias("var"))


def sharpe_or_infinite(mean: Column, sd: Column) -> Column:
    """Mean over deviation; a deviation that is rounding noise gives 0 or a signed infinity."""
    noise = sd <= 1e-12 * F.greatest(F.lit(1.0), F.abs(mean))
    return (F.when(noise & (mean == 0), 0.0)
            .when(noise, F.signum(mean) * float("inf"))
            .otherwise(mean / sd))


def risk_metrics(equity: DataFrame, trading_days: int = TRADING_DAYS) -> DataFrame:
    """One row per entity with at least three values; every figure names its frequency."""
    order = W.partitionBy("entity_id").orderBy("effective_date")
    steps = drawdown_series(equity).withColumn("_r", F.col("value") / F.lag("value").over(order) - 1)
    scale = math.sqrt(trading_days)
    per = steps.groupBy("entity_id").agg(
        F.count("_r").alias("n_observations"),
        F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("volatility_per_period"),
        (-F.min("drawdown")).alias("max_drawdown"),
        (100 * F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown")))).alias("ulcer_index"),
        floored_var(F.col("_r"), 0.95).alias("var_95"),
        floored_var(F.col("_r"), 0.99).alias("var_99"))
    sharpe = sharpe_or_infinite(F.col("_mean"), F.col("volatility_per_period"))
    return per.where("n_observations >= 2").select(
        "entity_id", "n_observations", "max_drawdown", "ulcer_index", "volatility_per_period",
        (F.col("volatility_per_period") * scale).alias("volatility_annualised"),
        sharpe.alias("sharpe_per_period"), (sharpe * scale).alias("sharpe_annualised"),
        "var_95", "var_99")


def per_period_sharpe(equity: DataFrame) -> DataFrame:
    """Sharpe of each curve: difference first, then drop what is not finite."""
    order = W.partitionBy("entity_id").orderBy("effective_date")
    before = F.lag("value").over(order)
    steps = equity.withColumn("_r", F.col("value") / F.nullif(before, F.lit(0.0)) - 1)
    per = steps.groupBy("entity_id").agg(
        F.count(F.when(finite(F.col("_r")), 1)).alias("n"),
        F.avg(F.when(finite(F.col("_r")), F.col("_r"))).alias("mean"),
        F.stddev_samp(F.when(finite(F.col("_r")), F.col("_r"))).alias("sd"))
    return per.select("entity_id", "n", F.when((F.col("n") >= 2) & (F.col("sd") > 0),
                                               F.col("mean") / F.col("sd")).otherwise(0.0)
                      .alias("sharpe"))


def path_outcomes(paths: DataFrame, initial_value: float) -> DataFrame:
    """One row per path: total return, horizon, worst drawdown, ruin."""
    falls = drawdown_series(paths, "path_id", "step")
    return falls.groupBy("path_id").agg(
        (F.max_by("value", "step") / initial_value - 1).alias("total_return"),
        F.max("step").alias("horizon"), (-F.min("drawdown")).alias("max_drawdown"),
        (F.max_by("value", "step") <= 0).alias("ruined"))


def path_statistics(outcomes: DataFrame, trading_days: int = TRADING_DAYS) -> DataFrame:
    """Outcome statistics over all paths, in one row.

    Quantiles are ranked across tasks, so the number of paths is not limited by
    what one reducer can hold; the tail means are a second pass that joins the
    single row of quantiles.
    """
    paths = materialise(outcomes.withColumn("annualised", annualise_return(
        F.col("total_return"), F.col("horizon"), trading_days)), "outcomes")
    long = paths.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("v"))
        for c in ("total_return", "max_drawdown", "annualised")])).alias("m")).select("m.*")
    q = exact_quantiles(long, "v", [0.01, 0.05, 0.5, 0.95, 0.99], ["measure"])

    def pick(measure: str, p: float) -> Column:
        return F.max(F.when((F.col("measure") == measure) & (F.col("probability") == p),
                            F.col("quantile")))

    cuts = q.agg(pick("total_return", 0.05).alias("q05"), pick("total_return", 0.01).alias("q01"),
                 pick("annualised", 0.5).alias("median"),
                 pick("max_drawdown", 0.95).alias("dd95"), pick("max_drawdown", 0.99).alias("dd99"))
    cut = one_row(cuts)
    r = F.col("total_return")
    return paths.select("*", cut.alias("cut")).groupBy("cut").agg(
        F.count(F.lit(1)).alias("n_paths"),
        F.avg("annualised").alias("mean_annualised_return"),
        F.coalesce(F.stddev_samp("annualised"), F.lit(0.0)).alias("terminal_dispersion"),
        F.avg((r < 0).cast("double")).alias("probability_of_loss"),
        F.avg(F.col("ruined").cast("double")).alias("ruin_probability"),
        (-F.avg(F.when(r <= F.col("cut.q05"), r))).alias("_es95"),
        (-F.avg(F.when(r <= F.col("cut.q01"), r))).alias("_es99"),
        F.avg("max_drawdown").alias("mean_max_drawdown"),
        F.min(r).alias("worst_terminal_return"), F.max(r).alias("best_terminal_return"),
    ).select(
        "n_paths", "mean_annualised_return", F.col("cut.median").alias("median_annualised_return"),
        "terminal_dispersion", "probability_of_loss", "ruin_probability",
        (-F.col("cut.q05")).alias("var_95"), (-F.col("cut.q01")).alias("var_99"),
        F.coalesce("_es95", -F.col("cut.q05")).alias("expected_shortfall_95"),
        F.coalesce("_es99", -F.col("cut.q01")).alias("expected_shortfall_99"),
        "mean_max_drawdown", F.col("cut.dd95").alias("max_drawdown_95"),
        F.col("cut.dd99").alias("max_drawdown_99"),
        "worst_terminal_return", "best_terminal_return")
