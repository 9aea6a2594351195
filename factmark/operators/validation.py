"""Splitting input into what can be used and what is refused, with the reason."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, required_text


def _with_reason(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """First matching rule names the reason; a rule whose test is NULL does not match."""
    reason = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        reason = F.when(broken, F.lit(text)).otherwise(reason)
    return df.withColumn("reason", reason)


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("reason IS NULL").drop("reason"), df.where("reason IS NOT NULL")


def fact_reasons(facts: DataFrame) -> DataFrame:
    """Every fact with the reason it cannot be stored, NULL when it can."""
    return _with_reason(
        facts,
        (F.col("entity_id").isNull(), "missing entity_id"),
        (F.col("field").isNull(), "missing field"),
        (F.col("effective_date").isNull(), "missing effective_date"),
        (F.col("knowledge_date").isNull(), "missing knowledge_date"),
        (F.col("knowledge_date") < F.col("effective_date"), "known before its period"))


def split_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts fit to be stored, and the others with what is wrong with each."""
    return _split(fact_reasons(facts))


def split_instruments(instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): price, volume, volatility and share count must be positive."""
    positive = ["price", "adv", "daily_volatility", "shares_outstanding"]
    return _split(_with_reason(instruments, *[
        (~F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False)), f"{c} must be positive")
        for c in positive]))


def split_registrations(registrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): a registration states a family, a hypothesis and a prediction."""
    return _split(_with_reason(
        registrations,
        (~required_text(F.col("strategy_family")), "strategy_family is required"),
        (~required_text(F.col("hypothesis")), "hypothesis is required"),
        (~required_text(F.col("expected_result")), "expected_result is required"),
        (~required_text(F.col("expected_result"), 10), "expected_result is not falsifiable")))


def split_holdouts(periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): a period needs both ends, the first before the last."""
    return _split(_with_reason(
        periods, (~F.coalesce(F.col("start_date") < F.col("end_date"), F.lit(False)),
                  "needs start < end")))
