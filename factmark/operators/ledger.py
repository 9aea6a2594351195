"""Questions asked of append-only ledgers: trials, holdouts, runs.

The rules a transactional store would enforce row by row are checked here over the
whole log at once: an event log that breaks one shows up in ``*_violations``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import HoldoutViolation
from ..functions.deflation import (deflated_against, length_against, plausible_per_period,
                                   scaled_expected_max, unit_expected_max, verdict)

CAUTION_FROM, EXHAUSTED_FROM = 2, 4


# --- trials -------------------------------------------------------------------

def trial_counts(trials: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Every trial counts, whether or not it ever reported a result."""
    return trials.groupBy(by).agg(F.count(F.lit(1)).alias("n_trials"))


def deflation_inputs(trials: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Trial count and the variance of reported Sharpes; NULL variance below two reports."""
    return trials.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count("sharpe").alias("trials_with_outcome"),
        (F.count(F.lit(1)) - F.count("sharpe")).alias("trials_without_outcome"),
        F.when(F.count("sharpe") >= 2, F.var_samp("sharpe")).alias("var_trials"))


def deflated_results(results: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Deflate rows of (observed_sharpe, n_trials, sample_length, skew, kurtosis, var_trials).

    Nothing is deflated where the variance across trials is unknown or zero.
    """
    observed, length = F.col("observed_sharpe"), F.col("sample_length")
    searched = F.when(F.col("var_trials") > 0, F.col("var_trials"))
    out = (results.withColumn("_unit", unit_expected_max(F.col("n_trials")))
           .withColumns({"expected_max_sharpe": scaled_expected_max(F.col("_unit"), searched),
                         "min_backtest_length": length_against(observed, F.col("_unit"))}))
    short = F.coalesce(length < F.col("min_backtest_length"), F.lit(False))
    out = out.withColumns({
        "deflated_sharpe": deflated_against(observed, F.col("expected_max_sharpe"), length,
                                            F.col("skew"), F.col("kurtosis")),
        "sample_too_short": short})
    return out.withColumn("significant", verdict(
        F.col("deflated_sharpe"), length, F.col("min_backtest_length"), threshold)).drop("_unit")


def implausible_sharpes(trials: DataFrame) -> DataFrame:
    """Reported figures that can only be annualised ones filed as per-period."""
    return trials.where(F.col("sharpe").isNotNull() & ~plausible_per_period(F.col("sharpe")))


def trial_violations(log: DataFrame) -> DataFrame:
    """(trial_id, rule) for a log of (trial_id, kind, dataset_id, search_id) events.

    A trial starts once under one identity and reports at most once, after starting.
    """
    started, outcome = (F.sum((F.col("kind") == k).cast("long")) for k in ("started", "outcome"))
    per = log.groupBy("trial_id").agg(
        started.alias("starts"), outcome.alias("outcomes"),
        F.min(F.struct("dataset_id", "search_id")).alias("lo"),
        F.max(F.struct("dataset_id", "search_id")).alias("hi"))
    return _broken_rules(per, "trial_id", {
        "second outcome": F.col("outcomes") > 1,
        "outcome without start": (F.col("outcomes") > 0) & (F.col("starts") == 0),
        "changed identity": ~F.col("lo").eqNullSafe(F.col("hi"))})


def _broken_rules(per: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    found = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name))
                                                for name, test in rules.items()])))
    return per.select(key, found.alias("rule"))


# --- holdouts -------------------------------------------------------------------

def overlapping_requests(requests: DataFrame, periods: DataFrame) -> DataFrame:
    """Requests (dataset_id, start_date, end_date) with the verdict per row.

    Overlap is inclusive at both ends; a dataset without a period is unrestricted.
    """
    held = periods.select("dataset_id", F.col("start_date").alias("held_from"),
                          F.col("end_date").alias("held_to"))
    hit = (F.col("start_date") <= F.col("held_to")) & (F.col("end_date") >= F.col("held_from"))
    return requests.join(held, "dataset_id", "left").withColumn(
        "refused", F.coalesce(hit, F.lit(False)))


def require_ordinary_access(requests: DataFrame, periods: DataFrame) -> None:
    for row in overlapping_requests(requests, periods).where("refused").take(1):
        raise HoldoutViolation(
            f"{row.dataset_id!r} {row.start_date}..{row.end_date} overlaps the holdout "
            f"{row.held_from}..{row.held_to}")


def guarded_series(observations: DataFrame, dataset_id: str, periods: DataFrame) -> DataFrame:
    """The observations, once the range they really span is checked against the holdout."""
    span = observations.agg(F.lit(dataset_id).alias("dataset_id"),
                            F.min("effective_date").alias("start_date"),
                            F.max("effective_date").alias("end_date"))
    require_ordinary_access(span, periods)
    return observations


def series_ranges(observations: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """The range each dataset's data covers, to be checked instead of a declared one."""
    return observations.groupBy(dataset).agg(F.min("effective_date").alias("start_date"),
                                             F.max("effective_date").alias("end_date"))


def holdout_exhaustion(evaluations: DataFrame) -> DataFrame:
    """How often each family has looked at each holdout, and what that makes it."""
    n = F.col("evaluations")
    tier = (F.when(n >= EXHAUSTED_FROM, "exhausted").when(n >= CAUTION_FROM, "caution")
            .otherwise("none"))
    return (evaluations.groupBy("dataset_id", "strategy_family")
            .agg(F.count(F.lit(1)).alias("evaluations"))
            .withColumn("exhausted", n > 1).withColumn("warning", tier))


def unregistered_evaluations(evaluations: DataFrame, registrations: DataFrame) -> DataFrame:
    return evaluations.join(registrations, "registration_id", "left_anti")


def double_spent(evaluations: DataFrame) -> DataFrame:
    """Registrations that bought more than one look."""
    return (evaluations.groupBy("registration_id").agg(F.count(F.lit(1)).alias("looks"))
            .where("looks > 1"))


def holdout_violations(periods: DataFrame, registrations: DataFrame) -> DataFrame:
    """(key, rule): a period defined twice differently, a registration edited after the fact."""
    moved = periods.groupBy(F.col("dataset_id").alias("key")).agg(
        F.min(F.struct("start_date", "end_date")).alias("lo"),
        F.max(F.struct("start_date", "end_date")).alias("hi"))
    said = F.struct("dataset_id", "strategy_family", "hypothesis", "expected_result")
    edited = registrations.groupBy(F.col("registration_id").alias("key")).agg(
        F.min(said).alias("lo"), F.max(said).alias("hi"))
    changed = ~F.col("lo").eqNullSafe(F.col("hi"))
    return (_broken_rules(moved, "key", {"second holdout period": changed})
            .unionByName(_broken_rules(edited, "key", {"edited registration": changed})))


# --- runs ------------------------------------------------------------------------

def search_runs(runs: DataFrame, strategy: str | None = None, factor: str | None = None,
                since=None, until=None, outcome: str | None = None) -> DataFrame:
    """Runs by strategy, factor, start range and outcome, oldest first."""
    for value, test in (
            (strategy, F.col("strategy") == strategy),
            (factor, F.array_contains("factors", factor or "")),
            (since, F.col("started_at") >= F.lit(since).cast("timestamp")),
            (until, F.col("started_at") <= F.lit(until).cast("timestamp")),
            (outcome, F.col("outcome") == outcome)):
        if value is not None:
            runs = runs.where(test)
    return runs.orderBy("started_at")


def records(ledger: DataFrame, time: str, **equals) -> DataFrame:
    """Full records of a ledger, optionally for given key values, in time order."""
    for column, value in equals.items():
        ledger = ledger.where(F.col(column) == value)
    return ledger.orderBy(time)


def ledger_provenance(trials: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Totals beside ages, so a freshly reset ledger shows as a young one."""
    now = F.lit(as_of).cast("timestamp")
    counted = trials.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_trials"), F.min("started_at").alias("first_trial"))
    run_counts = runs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_runs"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("first_trial").cast("timestamp"))) / 86_400e6
    return counted.join(run_counts, "dataset_id", "left").select(
        "dataset_id", "n_trials", F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        age.alias("age_days"))


def run_violations(log: DataFrame) -> DataFrame:
    """(run_id, rule) for a log of (run_id, kind, identity, result_hash) events."""
    per = log.groupBy("run_id").agg(
        F.sum((F.col("kind") == "started").cast("long")).alias("starts"),
        F.min("identity").alias("lo"), F.max("identity").alias("hi"),
        F.min("result_hash").alias("h_lo"), F.max("result_hash").alias("h_hi"))
    return _broken_rules(per, "run_id", {
        "changed identity": F.col("lo") != F.col("hi"),
        "result rewritten": F.col("h_lo") != F.col("h_hi"),
        "result without start": F.col("h_lo").isNotNull() & (F.col("starts") == 0)})
