"""End-to-end jobs: counted sweeps, null benchmarks, rule families, gated runs."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..errors import ResearchError
from ..operators import factors, fingerprint, ledger, sweep
from ..operators.bitemporal import require_point_in_time, series
from ..operators.folds import leakage_report
from ..session import materialise
from ..sources import versions as store


# Significant digits a replayed search must reproduce.
REPLAY_DIGITS = 10


def returns_of(panel: DataFrame) -> DataFrame:
    return factors.simple_returns(panel).where(F.col("ret").isNotNull()).select(
        "entity_id", "effective_date", "ret")


# --- counted sweeps -----------------------------------------------------------------

STARTED = ("trial_id string, search_id string, entity_id string, trial_ord int, "
           "started_at timestamp, dataset_id string, attempt string")
OUTCOMES = "trial_id string, sharpe double, dataset_id string, attempt string"


def _record(rows: DataFrame, path: str, dataset_id: str, attempt: str) -> None:
    """Write what one attempt knows; writing it again replaces it and adds nothing."""
    (rows.withColumns({"dataset_id": F.lit(dataset_id), "attempt": F.lit(attempt)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset_id", "attempt").parquet(path))


def start_trials(entities: DataFrame, n_params: int, attempt: str, search_id: str) -> DataFrame:
    """One row per (series, parameter set), with an id of its own, before any result exists."""
    order = F.explode(F.sequence(F.lit(0), F.lit(n_params - 1))).alias("trial_ord")
    return entities.select("entity_id", order).select(
        F.concat_ws("/", F.lit(attempt), "entity_id", "trial_ord").alias("trial_id"),
        F.lit(search_id).alias("search_id"), "entity_id", "trial_ord",
        F.current_timestamp().alias("started_at"))


def trials_of(spark: SparkSession, ledger_path: str, dataset_id: str) -> DataFrame:
    """Every trial ever started on a dataset, ``sharpe`` NULL where none was reported."""
    started = spark.read.schema(STARTED).parquet(f"{ledger_path}/started").where(
        F.col("dataset_id") == dataset_id)
    reported = spark.read.schema(OUTCOMES).parquet(f"{ledger_path}/outcomes").where(
        F.col("dataset_id") == dataset_id).select("trial_id", "sharpe")
    return started.join(reported, "trial_id", "left")


def deflate_sweep(trials: DataFrame, attempt: str, params: DataFrame,
                  moments: DataFrame) -> DataFrame:
    """One row per series of an attempt, deflated by all trials of its dataset.

    The best figure is the attempt's own; how many trials it is the best of, and how much
    they vary, is counted over every search on the same series. A series whose every trial
    failed keeps its row: ``status`` says so. Skewness and kurtosis are those of the
    market returns that were searched over.
    """
    mine = trials.where(F.col("attempt") == attempt)
    counted = ledger.deflation_inputs(trials, "entity_id").select(
        "entity_id", "n_trials", "trials_with_outcome", "var_trials")
    best = sweep.best_trial(mine.where(F.col("sharpe").isNotNull()), params)
    market = moments.select("entity_id", F.col("n_observations").alias("sample_length"),
                            "skew", "kurtosis")
    rows = (mine.select("entity_id").distinct().join(counted, "entity_id")
            .join(best, "entity_id", "left").join(market, "entity_id", "left"))
    status = F.when(F.col("best_sharpe").isNull(), "no trial reported").otherwise("searched")
    return ledger.deflated_results(rows.withColumns(
        {"observed_sharpe": F.col("best_sharpe"), "status": status}))


def counted_sweep(returns: DataFrame, params: list[dict] | DataFrame, ledger_path: str, search_id: str,
                  rule: sweep.Rule | None = None, dataset_id: str = "returns",
                  attempt: str | None = None) -> DataFrame:
    """Register every trial, evaluate, record the outcomes, deflate from the record.

    ``returns`` is (entity_id, effective_date, ret). Starts are written before anything
    is evaluated, and the deflation reads the ledger, not the evaluation. Each call is an
    attempt that adds to the burden of its dataset; a caller that repeats a call after a
    failure gives the same ``attempt`` and adds nothing.
    """
    spark, params = returns.sparkSession, sweep.parameter_list(params)
    attempt = attempt or uuid.uuid4().hex
    returns = materialise(returns.select("entity_id", "effective_date", "ret"), "returns")
    entities = returns.select("entity_id").distinct()
    _record(start_trials(entities, len(params), attempt, search_id), f"{ledger_path}/started",
            dataset_id, attempt)
    outcomes = sweep.sweep(returns, params, rule or sweep.crossover_rule()).select(
        F.concat_ws("/", F.lit(attempt), "entity_id", "trial_ord").alias("trial_id"), "sharpe")
    _record(outcomes, f"{ledger_path}/outcomes", dataset_id, attempt)
    trials = trials_of(spark, ledger_path, dataset_id)
    sweep.require_results(trials.where(
        (F.col("attempt") == attempt) & F.col("sharpe").isNotNull()))
    return deflate_sweep(trials, attempt, sweep.parameter_frame(spark, params),
                         sweep.return_moments(returns))


def null_benchmark(returns: DataFrame, params: list[dict] | DataFrame, ledger_path: str, search_id: str,
                   seed: int = 0, dataset_id: str = "returns", **kwargs) -> DataFrame:
    """What the search finds where order was destroyed. Reshuffled series are a dataset of
    their own, so the null adds nothing to the burden of the real one."""
    return counted_sweep(sweep.reshuffle(returns, seed), params, ledger_path, search_id,
                         dataset_id=f"{dataset_id} reshuffled {seed}",
                         **kwargs).withColumn("shuffle_seed", F.lit(seed))


# --- published tables -------------------------------------------------------------------

def deflation_table(results: DataFrame, trial_counts: list[int], sample_length: int) -> DataFrame:
    """Each result once per assumed trial count, with a normal series of one length."""
    counts = F.explode(F.array(*[F.lit(n).cast("long") for n in trial_counts])).alias("n_trials")
    rows = results.select("entity_id", "observed_sharpe", "var_trials", counts).withColumns({
        "sample_length": F.lit(sample_length), "skew": F.lit(0.0), "kurtosis": F.lit(3.0)})
    return ledger.deflated_results(rows)


def leakage_by_horizon(labels: DataFrame, horizons: list[int], n_splits: int = 5,
                       embargo_pct: float = 0.01) -> DataFrame:
    """Leak counts when each label resolves h rows (days) after it starts."""
    h = F.explode(F.array(*[F.lit(x) for x in horizons])).alias("h")
    many = labels.select("series_id", "idx", "t0", h).select(
        F.concat_ws("|", "series_id", F.col("h").cast("string")).alias("series_id"), "idx", "t0",
        F.date_add("t0", F.col("h")).alias("t1"))
    report = leakage_report(many, n_splits, embargo_pct)
    parts = F.split("series_id", r"\|")
    return report.withColumns({"horizon": F.element_at(parts, -1).cast("int"),
                               "series_id": F.element_at(parts, 1)})


# --- a rule family, in sample and held out ------------------------------------------------

def timing_family(panel: DataFrame, windows: list[int], trial_counts: list[int]) -> DataFrame:
    """Each series' best window and its Sharpe deflated at several search sizes."""
    family = sweep.timing_summary(sweep.timing_returns(panel, windows))
    best = F.max(F.struct("sharpe_per_period", (-F.col("window")).alias("o"), "n_periods"))
    per = family.groupBy("entity_id").agg(
        F.var_samp("sharpe_per_period").alias("var_trials"), best.alias("b"),
        F.min("max_drawdown").alias("shallowest"), F.max("max_drawdown").alias("deepest"))
    counts = F.explode(F.array(*[F.lit(n).cast("long") for n in trial_counts])).alias("n_trials")
    rows = per.select(
        "entity_id", (-F.col("b.o")).alias("best_window"), "shallowest", "deepest", "var_trials",
        F.col("b.sharpe_per_period").alias("observed_sharpe"),
        F.col("b.n_periods").alias("sample_length"), F.lit(0.0).alias("skew"),
        F.lit(3.0).alias("kurtosis"), counts)
    return ledger.deflated_results(rows)


def timing_on_holdout(panel: DataFrame, window: int, held_from) -> DataFrame:
    """The rule on the held-out stretch, warmed up on the ``window`` rows before it."""
    cut = F.lit(str(held_from)).cast("date")
    before = panel.where(F.col("effective_date") < cut)
    warm = before.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_before"))
    order = factors.by_entity()
    kept = (panel.withColumn("_t", F.row_number().over(order)).join(warm, "entity_id", "left")
            .where(F.col("_t") > F.coalesce("n_before", F.lit(0)) - window))
    rows = sweep.timing_returns(kept.select("entity_id", "effective_date", "value"), [window])
    rule = sweep.timing_summary(rows).select(
        "entity_id", "n_periods", F.col("sharpe_annualised").alias("rule_sharpe"),
        F.col("max_drawdown").alias("rule_drawdown"))
    market = sweep.timing_summary(rows, "market").select(
        "entity_id", F.col("sharpe_annualised").alias("market_sharpe"),
        F.col("max_drawdown").alias("market_drawdown"))
    return rule.join(market, "entity_id").withColumns({
        "drawdown_held": F.col("rule_drawdown") < F.col("market_drawdown") * 2 / 3,
        "sharpe_held": F.col("rule_sharpe") >= F.col("market_sharpe") - 0.05})


# --- the gate ---------------------------------------------------------------------------------

def admit(spark: SparkSession, root: str, dataset_id: str, datasets: DataFrame,
          periods: DataFrame, observations: DataFrame) -> str:
    """Refusals in order, before anything is counted; returns the version a run will name."""
    require_point_in_time(datasets, dataset_id)
    ledger.guarded_series(observations, dataset_id, periods)
    current = store.current_versions(store.versions(spark, root, dataset_id)).first()
    if current is None:
        raise ResearchError(f"dataset {dataset_id!r} has no version: nothing was loaded")
    return current.version_id


OPENED = ("run_id string, search_id string, dataset_id string, dataset_version string, "
          "version_number int, field string, params string, known_by string, until string, "
          "strategy string, factors array<string>, started_at timestamp")
CLOSED = ("run_id string, outcome string, error string, row_count long, content_hash string, "
          "ended_at timestamp")


def _closed(spark: SparkSession, ledger_path: str, run_id: str, outcome: str,
            error: str | None = None, rows: int | None = None, digest: str | None = None) -> None:
    (spark.createDataFrame([(run_id, outcome, error, rows, digest, None)], CLOSED)
     .withColumn("ended_at", F.current_timestamp()).coalesce(1)
     .write.mode("overwrite").parquet(f"{ledger_path}/runs_closed/run={run_id}"))


def run_records(spark: SparkSession, ledger_path: str) -> DataFrame:
    """Every run with all that is needed to repeat it. ``outcome`` is completed or failed,
    or unfinished where a run was opened and never closed."""
    opened = spark.read.schema(OPENED).parquet(f"{ledger_path}/runs_opened")
    try:
        closed = spark.read.schema(CLOSED).parquet(f"{ledger_path}/runs_closed")
    except AnalysisException:  # none has ended yet
        closed = spark.createDataFrame([], CLOSED)
    return opened.drop("run").join(closed.drop("run"), "run_id", "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("unfinished")))


def _own_figures(spark: SparkSession, ledger_path: str, dataset_id: str, attempt: str) -> DataFrame:
    """What an attempt itself found; the burden of other searches is no part of it."""
    return trials_of(spark, ledger_path, dataset_id).where(F.col("attempt") == attempt).select(
        "entity_id", "trial_ord", "sharpe")


def gated_search(spark: SparkSession, root: str, dataset_id: str, field: str,
                 datasets: DataFrame, periods: DataFrame, ledger_path: str,
                 params: list[dict] | DataFrame, end=None, known_by=None, search_id: str = "search",
                 run_id: str | None = None) -> DataFrame:
    """Read, admit, register, execute, record: a sweep over stored series.

    The range checked against the holdout is that of the data read, not a declared one. A
    run that is admitted is opened in the log before anything is evaluated, and closed as
    completed or failed; a repeat after a lost driver gives the same ``run_id``.
    """
    params = sweep.parameter_list(params)
    panel = series(store.read(spark, root, dataset_id, datasets), field, known_by, end=end)
    version = admit(spark, root, dataset_id, datasets, periods, panel)
    if len(panel.limit(3).collect()) < 3:
        raise ResearchError(f"{dataset_id!r} has no two returns of {field!r} to search over")
    run_id = run_id or uuid.uuid4().hex
    words = [None if x is None else str(x) for x in (known_by, end)]
    opened = [(run_id, search_id, dataset_id, version, int(version.rpartition("@v")[2]), field,
               json.dumps(params), *words, "crossover", [field], None)]
    (spark.createDataFrame(opened, OPENED).withColumn("started_at", F.current_timestamp())
     .coalesce(1).write.mode("overwrite").parquet(f"{ledger_path}/runs_opened/run={run_id}"))
    try:
        result = counted_sweep(returns_of(panel), params, ledger_path, search_id,
                               dataset_id=dataset_id, attempt=run_id)
        found = fingerprint.fingerprint(_own_figures(spark, ledger_path, dataset_id, run_id),
                                        digits=REPLAY_DIGITS).first()
    except Exception as error:
        _closed(spark, ledger_path, run_id, "failed", f"{type(error).__name__}: {error}"[:500])
        raise
    _closed(spark, ledger_path, run_id, "completed", rows=found.row_count,
            digest=found.content_hash)
    return result.withColumns({"dataset_version": F.lit(version), "run_id": F.lit(run_id)})


def replay_search(spark: SparkSession, root: str, ledger_path: str, run_id: str,
                  scratch: str) -> DataFrame:
    """Repeat a recorded run from its record alone, against a throwaway ledger, and compare."""
    records = run_records(spark, ledger_path).where(F.col("run_id") == run_id)
    record = records.first()
    if record is None:
        raise ResearchError(f"no run {run_id!r} in the log")
    facts = store.read_facts(spark, root, record.dataset_id).where(
        F.col("version_number") <= record.version_number)
    panel = series(facts, record.field, record.known_by, end=record.until)
    counted_sweep(returns_of(panel), json.loads(record.params), scratch, record.search_id,
                  dataset_id=record.dataset_id, attempt=run_id)
    replayed = fingerprint.fingerprint(
        _own_figures(spark, scratch, record.dataset_id, run_id),
        digits=REPLAY_DIGITS).withColumn("run_id", F.lit(run_id))
    return fingerprint.replay_check(records, replayed, ["run_id"])
