"""Price and fundamental factors over long panels."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import LookAheadFactor, ResearchError
from ..functions.scalars import TRADING_DAYS, finite, size_factor
from ..session import materialise

Factor = Callable[[DataFrame], DataFrame]


def by_entity() -> W:
    """Time order inside an entity; one row per calendar day at most (see package note)."""
    return W.partitionBy("entity_id").orderBy("effective_date")


def split_priceable(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel of entities whose prices are all positive and finite, refused entities)."""
    bad = (panel.where(~(finite(F.col("value")) & (F.col("value") > 0)))
           .groupBy("entity_id").agg(F.count(F.lit(1)).alias("bad_prices"),
                                     F.min("effective_date").alias("first_bad")))
    return panel.join(bad.select("entity_id"), "entity_id", "left_anti"), bad


def simple_returns(panel: DataFrame, column: str = "ret") -> DataFrame:
    p = F.col("value")
    return panel.withColumn(column, p / F.lag(p).over(by_entity()) - 1)


def cumulative_price(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Product of (1 + r) per entity, for r >= -1; after a total loss it stays 0."""
    upto = by_entity().rowsBetween(W.unboundedPreceding, W.currentRow)
    lost = F.max(F.col(ret) <= -1).over(upto)
    return returns.withColumn("price", F.when(lost, 0.0).otherwise(
        F.exp(F.sum(F.log1p(ret)).over(upto))))


def momentum(panel: DataFrame, lookback: int = TRADING_DAYS, skip: int = 21) -> DataFrame:
    """Return from t-lookback to t-skip; the skipped stretch reverses and is left out."""
    if skip < 0 or lookback <= skip:
        raise ResearchError("need lookback > skip >= 0")
    past = lambda k: F.lag("value", k).over(by_entity()) if k else F.col("value")
    return panel.withColumn("factor", past(skip) / past(lookback) - 1)


def reversal(panel: DataFrame, lookback: int = 21) -> DataFrame:
    """Negative of the trailing return."""
    if lookback < 1:
        raise ResearchError("lookback must be at least 1")
    return panel.withColumn(
        "factor", 1 - F.col("value") / F.lag("value", lookback).over(by_entity()))


def realised_volatility(panel: DataFrame, window: int = 21, annualise: bool = True) -> DataFrame:
    """Trailing sample deviation of log returns; NULL until the window is full."""
    if window < 2:
        raise ResearchError("window must be at least 2")
    frame = by_entity().rowsBetween(1 - window, W.currentRow)
    scale = math.sqrt(TRADING_DAYS) if annualise else 1.0
    logged = panel.withColumn("_r", F.log(F.col("value") / F.lag("value").over(by_entity())))
    return (logged.withColumn("factor", F.when(F.count("_r").over(frame) == window,
                                               F.stddev_samp("_r").over(frame) * scale))
            .drop("_r"))


def market_size(caps: DataFrame) -> DataFrame:
    return caps.withColumn("factor", size_factor(F.col("value")))


def unusable_caps(caps: DataFrame) -> DataFrame:
    """Rows that ``book_to_market`` cannot use, with the reason."""
    return caps.where(~F.coalesce(F.col("value") > 0, F.lit(False))).withColumn(
        "reason", F.when(F.col("value").isNull(), "no market cap").otherwise(
            "market cap is not positive"))


def book_to_market(caps: DataFrame, first_reports: DataFrame) -> DataFrame:
    """Book equity known at each date over market cap.

    Two selections kept apart: the latest period known, then that period's *first*
    report. ``first_reports`` already holds one row per period (its first report and
    the day it became known), so unioning it with the panel and carrying the running
    maximum of (period, value) gives both in one sort per entity, no range join.
    NULL during the reporting lag. Rows whose cap is not positive have no ratio; they
    are in ``unusable_caps``.
    """
    reports = first_reports.select(
        "entity_id", F.col("knowledge_date").alias("_at"), F.lit(0).alias("_kind"),
        F.struct("effective_date", "value").alias("_report"),
        F.lit(None).cast("double").alias("market_cap"))
    dates = caps.where(F.col("value") > 0).select(
        "entity_id", F.col("effective_date").alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(reports.schema["_report"].dataType).alias("_report"),
        F.col("value").alias("market_cap"))
    so_far = (W.partitionBy("entity_id").orderBy("_at", "_kind")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    known = reports.union(dates).withColumn("_known", F.max("_report").over(so_far))
    return known.where("_kind = 1").select(
        "entity_id", F.col("_at").alias("effective_date"),
        F.col("_known.effective_date").alias("period"),
        (F.col("_known.value") / F.col("market_cap")).alias("factor"))


# --- the causality check ----------------------------------------------------------

def _keyed_uniform(seed: int, *columns: str) -> Column:
    """Repeatable uniform in [0, 1) per row."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def causality_check(factor: Factor, panel: DataFrame, split, seed: int = 0) -> DataFrame:
    """Per entity: factor values up to ``split`` compared before and after later data changed.

    Later prices are scaled by a factor in [1.5, 2.5). ``vacuous`` marks an entity
    whose whole head is NULL: nothing was compared, so it may not count as a pass. The panel
    is written first: computed twice, an average merged in another order differs in its last
    digits, and every value that reads it would seem to have moved.
    """
    panel = materialise(panel, "panel")
    cut = F.lit(str(split)).cast("date")
    late = F.col("effective_date") > cut
    shaken = panel.withColumn("value", F.when(late, F.col("value") * (
        1.5 + _keyed_uniform(seed, "entity_id", "effective_date"))).otherwise(F.col("value")))
    head = lambda df, name: (factor(df).where(~late)
                             .select("entity_id", "effective_date", F.col("factor").alias(name)))
    both = head(panel, "before").join(head(shaken, "after"),
                                      ["entity_id", "effective_date"], "full")
    return both.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("head_rows"),
        F.count("before").alias("compared"),
        F.sum((~F.col("before").eqNullSafe(F.col("after"))).cast("long")).alias("moved"),
        F.min(F.when(~F.col("before").eqNullSafe(F.col("after")), F.col("effective_date"))
              ).alias("first_moved"),
        (F.count("before") == 0).alias("vacuous"))


def assert_causal(factor: Factor, panel: DataFrame, split, seed: int = 0) -> None:
    """Raise if the factor reads the future, or if the check could not fail."""
    sides = panel.agg(
        F.min(F.col("effective_date") <= F.lit(str(split)).cast("date")).alias("all_head"),
        F.max(F.col("effective_date") <= F.lit(str(split)).cast("date")).alias("any_head")).first()
    if sides.all_head is None or sides.all_head or not sides.any_head:
        raise ResearchError("split must leave data on both sides")
    total = causality_check(factor, panel, split, seed).agg(
        F.sum("compared").alias("compared"), F.sum("moved").alias("moved"),
        F.min("first_moved").alias("first_moved")).first()
    if total.moved:
        raise LookAheadFactor(f"{total.moved} values moved, first on {total.first_moved}")
    if not total.compared:
        raise ResearchError("vacuous check: every value up to the split is NULL")


# --- registry -----------------------------------------------------------------------

# Name, direction of the premium, source.
REGISTRY = [
    ("momentum", "positive", "Jegadeesh & Titman (1993)"),
    ("reversal", "positive", "Jegadeesh (1990)"),
    ("volatility", "negative", "Ang, Hodrick, Xing & Zhang (2006)"),
    ("size", "negative", "Fama & French (1993)"),
    ("book_to_market", "positive", "Fama & French (1992)"),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "name string, direction string, citation string")
