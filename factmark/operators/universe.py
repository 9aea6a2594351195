"""Universe selection, build accounting, rank churn and factor portfolios."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ResearchError
from .bitemporal import honest_and_hindsight
from .ordering import bucket_of, with_position


def select_universe(companies: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` companies by registration number, before looking at any data.

    Numbers are given out before anything is known of a company's fate. Picking by what
    is visible today would leave out those that failed.
    """
    if limit < 1:
        raise ResearchError("a universe needs room for one company")
    return companies.select("cik").distinct().orderBy("cik").limit(limit)


def build_report(candidates: DataFrame, facts: DataFrame, errors: DataFrame | None = None
                 ) -> DataFrame:
    """Considered, loaded and skipped companies in one row; one reason per company."""
    loaded = facts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_facts"))
    state = candidates.select("entity_id").join(loaded, "entity_id", "left")
    if errors is not None:
        failed = errors.select("entity_id").distinct().withColumn("failed", F.lit(True))
        state = state.join(failed, "entity_id", "left")
    else:
        state = state.withColumn("failed", F.lit(None).cast("boolean"))
    has = F.col("n_facts").isNotNull()
    bad = F.coalesce("failed", F.lit(False)) & ~has
    count = lambda test: F.sum(test.cast("long"))
    return state.agg(
        F.count(F.lit(1)).alias("considered"), count(has).alias("loaded"),
        count(~has & ~bad).alias("skipped_no_data"), count(bad).alias("skipped_error"),
        F.coalesce(F.sum("n_facts"), F.lit(0)).alias("facts"),
        F.avg((~has).cast("double")).alias("skip_rate"))


def rank_and_bucket(values: DataFrame, column: str, buckets: int, prefix: str,
                    group: list[str] = ()) -> DataFrame:
    """0-based rank of ``column`` (ties by entity) and its bucket, ranked across tasks."""
    ranked = with_position(values, [column, "entity_id"], group, f"{prefix}_rank", "_size")
    return ranked.withColumn(
        f"{prefix}_bucket", bucket_of(F.col(f"{prefix}_rank"), F.col("_size"), buckets)
    ).drop("_size")


def rank_churn(facts: DataFrame, field: str, known_by, buckets: int = 10) -> DataFrame:
    """Ranks by first reports beside ranks by today's figures, over all companies."""
    if buckets < 2:
        raise ResearchError("one bucket cannot be moved between")
    pairs = honest_and_hindsight(facts, field, known_by).where(
        F.col("honest").isNotNull() & F.col("hindsight").isNotNull())
    ranked = rank_and_bucket(pairs, "honest", buckets, "honest")
    ranked = rank_and_bucket(ranked, "hindsight", buckets, "hindsight")
    restated = F.col("honest") != F.col("hindsight")
    moved = F.col("honest_bucket") != F.col("hindsight_bucket")
    out = ranked.agg(
        F.count(F.lit(1)).alias("companies"), F.sum(restated.cast("long")).alias("restated"),
        F.avg(restated.cast("double")).alias("restated_share"),
        F.coalesce(F.corr("honest_rank", "hindsight_rank"), F.lit(1.0)).alias("spearman"),
        F.sum(moved.cast("long")).alias("changed_bucket"),
        F.avg(moved.cast("double")).alias("changed_bucket_share"))
    return out.where(F.col("companies") >= buckets)


def factor_portfolio(panel: DataFrame, buckets: int = 5) -> DataFrame:
    """Per date: long the top bucket, short the bottom, against holding everything equally.

    ``panel`` is (entity_id, effective_date, factor, value). Ranks formed at t earn
    each entity's return to its next observation.
    """
    order = W.partitionBy("entity_id").orderBy("effective_date")
    rows = panel.withColumn("next_ret", F.lead("value").over(order) / F.col("value") - 1)
    usable = rows.where(F.col("factor").isNotNull() & F.col("next_ret").isNotNull()).select(
        "entity_id", "effective_date", "factor", "next_ret")
    ranked = rank_and_bucket(usable, "factor", buckets, "factor", ["effective_date"])
    leg = lambda b: F.avg(F.when(F.col("factor_bucket") == b, F.col("next_ret")))
    return ranked.groupBy("effective_date").agg(
        F.count(F.lit(1)).alias("names"),
        (leg(buckets - 1) - leg(0)).alias("long_short"),
        F.avg("next_ret").alias("equal_weight"))
