"""Sweeps, deflation, folds, leak checks and ledgers on the driver's tables."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions.normal import norm_cdf, norm_ppf
from ..operators import folds, ledger, sweep, table_functions, validation
from ..session import scratch_path
from . import bindings as b
from . import research
from .price_queries import TIMING_SQL, WINDOWS
from .registry import query, r6

FAST, SLOW = 40, 90


def windows_table(spark, fast: int, slow: int):
    """Pairs of a shorter and a longer window from 2 on, as a table of parameters."""
    return sweep.parameter_table(spark, "fast < slow", fast=range(2, fast + 1), slow=range(2, slow + 1))


def windows_count(fast: int, slow: int) -> int:
    return sum(slow - f for f in range(2, fast + 1))




# --- folds and leaks ---------------------------------------------------------------------

@query(f"""WITH {b.LABELS_SQL} SELECT series_id, idx, t0, t1 FROM labels""")
def label_index(spark, sf_dir):
    return b.labels(spark, sf_dir)


@query(f"""WITH {b.LABELS_SQL}
SELECT series_id, CAST(fold AS INTEGER) AS fold, role, count(*) AS rows, min(idx) AS first_idx,
       max(idx) AS last_idx FROM roles GROUP BY ALL""")
def purged_folds(spark, sf_dir):
    split, _ = folds.checked_folds(b.labels(spark, sf_dir))
    return split.groupBy("series_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"))


@query(f"""WITH {b.LABELS_SQL}
SELECT series_id, CAST(fold AS INTEGER) AS fold, idx FROM roles WHERE role = 'purged'""")
def purge_join(spark, sf_dir):
    """Training rows whose label interval overlaps a fold's test window."""
    return folds.purged_folds(b.labels(spark, sf_dir), roles=("purged",)).select(
        "series_id", "fold", "idx")


@query(f"""WITH {b.LABELS_SQL}
SELECT series_id, CAST(fold AS INTEGER) AS fold, count(*) FILTER (role = 'train') AS train,
       count(*) FILTER (role = 'test') AS test, count(*) FILTER (role = 'purged') AS purged,
       count(*) FILTER (role = 'embargoed') AS embargoed,
       count(*) FILTER (role = 'train') > 0 AS usable FROM roles GROUP BY 1, 2""")
def fold_sizes(spark, sf_dir):
    """Train and test rows of every fold, and what purge and embargo took out."""
    return folds.fold_sizes(folds.purged_folds(b.labels(spark, sf_dir)))


@query(f"""WITH {b.LABELS_SQL}, naive AS (
  SELECT series_id, fold, count(*) AS leaking_rows, min(idx) AS first_idx FROM roles
  WHERE role = 'purged' GROUP BY ALL)
SELECT 'naive' AS splitter, series_id, CAST(fold AS INTEGER) AS fold, leaking_rows, first_idx
FROM naive""")
def leakage_check(spark, sf_dir):
    """Any splitter's output checked: naive folds leak, purged ones contribute no row."""
    labels = b.labels(spark, sf_dir)
    purged = folds.purged_folds(labels)
    naive = purged.withColumn("role", F.when(F.col("role") == "test", "test").otherwise("train"))
    return (folds.leakage(naive, labels).withColumn("splitter", F.lit("naive"))
            .unionByName(folds.leakage(purged, labels).withColumn("splitter", F.lit("purged"))))


@query(f"""WITH {b.LABELS_SQL}
SELECT series_id, count(DISTINCT idx) AS observations,
       count(*) FILTER (role = 'purged') AS would_leak_under_naive_kfold,
       count(*) FILTER (role IN ('purged', 'embargoed')) AS removed_by_purge_and_embargo,
       round(count(*) FILTER (role = 'purged') / count(*)::DOUBLE, 6) AS leak_rate_naive
FROM roles GROUP BY 1""")
def leakage_report(spark, sf_dir):
    return folds.leakage_report(b.labels(spark, sf_dir)).withColumn(
        "leak_rate_naive", r6("leak_rate_naive"))


_HORIZONS = [1, 10, 25, 50]


@query(f"""WITH {b.LABELS_SQL}, h(horizon) AS (VALUES (1), (10), (25), (50)),
hb AS (SELECT series_id, horizon, fold, min(t0) AS test_start, max(t0 + horizon) AS test_end
       FROM sized, h GROUP BY series_id, horizon, fold)
SELECT l.series_id, horizon, count(*) FILTER (l.fold <> hb.fold AND l.t0 <= hb.test_end
         AND l.t0 + horizon >= hb.test_start) AS would_leak_under_naive_kfold
FROM sized l JOIN hb USING (series_id) GROUP BY l.series_id, horizon""")
def leakage_by_horizon(spark, sf_dir):
    return research.leakage_by_horizon(b.labels(spark, sf_dir), _HORIZONS).select(
        "series_id", "horizon", "would_leak_under_naive_kfold")


@query("""
SELECT series_id, 'label ends before it starts' AS reason, count(*) AS rows FROM (
  SELECT o_orderpriority AS series_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_shipdate < o_orderdate) GROUP BY 1""")
def label_problems(spark, sf_dir):
    """Labels that end before they start, series too short or unsorted."""
    lines = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("t1"), "l_linenumber", "l_partkey",
        "l_extendedprice")
    orders = b.table(spark, sf_dir, "orders")
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("t0"), "t1",
        "o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    indexed = folds.index_labels(rows, ["t0", "o_orderkey", "l_linenumber", "l_partkey",
                                        "l_extendedprice"])
    return folds.label_problems(indexed, 5)


@query("""
SELECT o_orderkey AS decision_id, count(l_orderkey) AS visible,
       coalesce(max(l_shipdate) > any_value(o_orderdate), false) AS future_visible,
       count(l_orderkey) > coalesce(max(l_linenumber), 0) AS extra_visible
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def lookahead_audit(spark, sf_dir):
    """Orders as decisions and their lines as inputs: which could see a later date?"""
    lines = b.table(spark, sf_dir, "lineitem")
    inputs = lines.select(F.col("l_orderkey").alias("decision_id"), F.col("l_shipdate").alias("ts"))
    sent = lines.groupBy(F.col("l_orderkey").alias("decision_id")).agg(
        F.max("l_linenumber").alias("delivered"))
    decisions = (b.table(spark, sf_dir, "orders")
                 .select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").alias("ts"))
                 .join(sent, "decision_id", "left").na.fill(0, ["delivered"]))
    return folds.lookahead_audit(decisions, inputs).select(
        "decision_id", "visible", "future_visible", "extra_visible")


# --- trials and deflation ------------------------------------------------------------------

@query(f"""WITH {b.TRIALS_SQL}
SELECT 'dataset' AS scope, dataset_id AS id, count(*) AS n_trials FROM trials GROUP BY 2
UNION ALL SELECT 'search', search_id, count(*) FROM trials GROUP BY 2""")
def trial_counts(spark, sf_dir):
    trials = b.trials(spark, sf_dir)
    return (ledger.trial_counts(trials).select(F.lit("dataset").alias("scope"),
                                               F.col("dataset_id").alias("id"), "n_trials")
            .unionByName(ledger.trial_counts(trials, "search_id").select(
                F.lit("search").alias("scope"), F.col("search_id").alias("id"), "n_trials")))


_INPUTS_SQL = f"""{b.TRIALS_SQL}, inputs AS (
  SELECT search_id, count(*) AS n_trials, count(sharpe) AS trials_with_outcome,
         count(*) - count(sharpe) AS trials_without_outcome,
         CASE WHEN count(sharpe) >= 2 THEN var_samp(sharpe) END AS var_trials,
         max(sharpe) AS best FROM trials GROUP BY 1)"""


@query(f"""WITH {_INPUTS_SQL}
SELECT search_id, n_trials, trials_with_outcome, trials_without_outcome,
       round(var_trials, 12) AS var_trials FROM inputs""")
def deflation_inputs(spark, sf_dir):
    return ledger.deflation_inputs(b.trials(spark, sf_dir), "search_id").withColumn(
        "var_trials", r6("var_trials", 12))


# The SQL twin has no error function: the CDF is a series and the quantile a bisection on it.
def _cdf_sql(x: str) -> str:
    """Taylor series of the normal CDF around zero, good to |x| < 8 at double precision."""
    return (f"(CASE WHEN {x} < -8 THEN 0.0 WHEN {x} > 8 THEN 1.0 ELSE 0.5 + "
            f"0.3989422804014327 * exp(-({x}) * ({x}) / 2) * list_sum(list_transform(range(0, 150), "
            f"lambda k: CASE WHEN k = 0 THEN ({x}) ELSE sign({x}) * exp((2 * k + 1) * "
            f"ln(greatest(abs({x}), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2.0) - lgamma(k + 1))) "
            f"END)) END)")


def _ppf_sql(p: str) -> str:
    step = _cdf_sql("(s.lo + s.hi) / 2")
    fold = (f"list_reduce(list_prepend({{'lo': -8.0::DOUBLE, 'hi': 8.0::DOUBLE}}, "
            f"list_transform(range(0, 50), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}})), "
            f"lambda s, i: CASE WHEN {step} < {p} THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} "
            f"ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END)")
    return f"(({fold}).lo)"


@query(f"""WITH z AS (
  SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()
         AS z FROM orders)
SELECT o_orderkey, round({_cdf_sql('z')}, 6) AS cdf, round(z, 6) AS back FROM z""")
def normal_round_trip(spark, sf_dir):
    """Standardised order totals through the CDF and back through the quantile."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    from ..operators.ordering import one_row
    stats = one_row(orders.agg(F.avg("o_totalprice").alias("m"),
                               F.stddev_samp("o_totalprice").alias("s")))
    z = (F.col("o_totalprice") - stats.getField("m")) / stats.getField("s")
    return orders.select("o_orderkey", z.alias("z")).select(
        "o_orderkey", norm_cdf(F.col("z")).alias("p")).select(
        "o_orderkey", r6("p").alias("cdf"), r6(norm_ppf(F.col("p"))).alias("back"))


def _deflate_sql(source: str, keep: str, tag: str = "") -> str:
    """CTEs ending in ``d``: rows of ``source`` with the deflated figures."""
    sizes, unit, z, d = (n + tag for n in ("sizes", "unit", "z", "d"))
    return f"""
{sizes} AS (SELECT DISTINCT n_trials FROM {source}),
{unit} AS (SELECT n_trials, CASE WHEN n_trials > 1 THEN
    (1 - 0.5772156649015329) * {_ppf_sql('(1.0 - 1.0 / n_trials)')}
    + 0.5772156649015329 * {_ppf_sql('(1.0 - exp(-1.0) / n_trials)')} ELSE 0 END AS e FROM {sizes}),
{z} AS (SELECT s.*, sqrt(var_trials) * e AS sr0, e,
    (observed_sharpe - sqrt(var_trials) * e) * sqrt(sample_length - 1)
      / sqrt(1 - skew * observed_sharpe + (kurtosis - 1) / 4 * observed_sharpe * observed_sharpe)
      AS stat FROM {source} s JOIN {unit} USING (n_trials)),
{d} AS (SELECT {keep}, CASE WHEN var_trials > 0 THEN round(sr0, 6) END AS expected_max_sharpe,
    CASE WHEN var_trials > 0 THEN round({_cdf_sql('stat')}, 6) END AS deflated_sharpe,
    CASE WHEN observed_sharpe > 0 THEN round(pow(e / observed_sharpe, 2), 4) END
      AS min_backtest_length,
    coalesce(CASE WHEN observed_sharpe > 0 THEN sample_length < pow(e / observed_sharpe, 2) END,
             false) AS sample_too_short FROM {z})"""


_RESULT_SQL = f"""{_INPUTS_SQL}, results AS (
  SELECT search_id, n_trials, var_trials, best AS observed_sharpe, 1250 AS sample_length,
         -0.5::DOUBLE AS skew, 5.0::DOUBLE AS kurtosis FROM inputs)"""


@query(f"""WITH {_RESULT_SQL}, {_deflate_sql('results', 'search_id, n_trials')} SELECT * FROM d""")
def deflated_sharpe(spark, sf_dir):
    """Best reported Sharpe of every search, deflated by that search's own size."""
    trials = b.trials(spark, sf_dir)
    best = trials.groupBy("search_id").agg(F.max("sharpe").alias("observed_sharpe"))
    rows = ledger.deflation_inputs(trials, "search_id").join(best, "search_id").withColumns({
        "sample_length": F.lit(1250), "skew": F.lit(-0.5), "kurtosis": F.lit(5.0)})
    return ledger.deflated_results(rows).select(
        "search_id", "n_trials", r6("expected_max_sharpe").alias("expected_max_sharpe"),
        r6("deflated_sharpe").alias("deflated_sharpe"),
        r6("min_backtest_length", 4).alias("min_backtest_length"), "sample_too_short")


_TABLE_SQL = f"""{b.TRIALS_SQL}, results AS (
  SELECT dataset_id AS entity_id, n AS n_trials, var_samp(sharpe) AS var_trials,
         max(sharpe) AS observed_sharpe, 1250 AS sample_length, 0.0::DOUBLE AS skew,
         3.0::DOUBLE AS kurtosis
  FROM trials, (VALUES (10), (100), (1000), (5000)) v(n) GROUP BY ALL)"""


@query(f"""WITH {_TABLE_SQL}, {_deflate_sql('results', 'entity_id, CAST(n_trials AS BIGINT) AS n_trials')}
SELECT entity_id, n_trials, deflated_sharpe, deflated_sharpe >= 0.95 AND NOT sample_too_short
       AS significant FROM d""")
def deflation_table(spark, sf_dir):
    """A dataset's best trial, deflated for four sizes of search."""
    per = b.trials(spark, sf_dir).groupBy(F.col("dataset_id").alias("entity_id")).agg(
        F.var_samp("sharpe").alias("var_trials"), F.max("sharpe").alias("observed_sharpe"))
    return research.deflation_table(per, [10, 100, 1000, 5000], 1250).select(
        "entity_id", "n_trials", r6("deflated_sharpe").alias("deflated_sharpe"), "significant")


@query("""SELECT CAST(event_id AS VARCHAR) AS trial_id, value / 100 AS sharpe FROM events
WHERE abs(value / 100) > 1""")
def implausible_sharpes(spark, sf_dir):
    trials = b.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("trial_id"), (F.col("value") / 100).alias("sharpe"))
    return ledger.implausible_sharpes(trials)


@query(f"""WITH {b.TRIAL_LOG_SQL}, per AS (
  SELECT trial_id, count(*) FILTER (kind = 'started') AS starts,
         count(*) FILTER (kind = 'outcome') AS outcomes, count(DISTINCT dataset_id) AS ids
  FROM trial_log GROUP BY 1)
SELECT trial_id, 'second outcome' AS rule FROM per WHERE outcomes > 1
UNION ALL SELECT trial_id, 'outcome without start' FROM per WHERE outcomes > 0 AND starts = 0
UNION ALL SELECT trial_id, 'changed identity' FROM per WHERE ids > 1""")
def ledger_violations(spark, sf_dir):
    """Trials whose log breaks an append-only rule."""
    return ledger.trial_violations(b.trial_log(spark, sf_dir))


# --- sweeps ------------------------------------------------------------------------------------

def _sweep_sql(source: str, tag: str = "", fast: int = 40, slow: int = 90) -> str:
    """CTEs from returns (entity_id, effective_date, ret) to every trial and the best."""
    px, means, trial, best = (n + tag for n in ("px", "means", "trial", "best"))
    return f"""
{px} AS (SELECT *, list(value) OVER (PARTITION BY entity_id ORDER BY effective_date
                ROWS BETWEEN {slow - 1} PRECEDING AND CURRENT ROW) AS recent
   FROM (SELECT entity_id, effective_date, row_number() OVER w AS t,
                count(*) OVER (PARTITION BY entity_id) AS n, lead(ret) OVER w AS nr,
                exp(sum(ln(1 + ret)) OVER w) AS value FROM {source}
         WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date))),
{means} AS (SELECT entity_id, t, k, list_avg(recent[-k:]) AS m
   FROM {px} JOIN (SELECT unnest(range(2, {slow + 1})) AS k) ks ON t >= k WHERE nr IS NOT NULL),
{trial} AS (SELECT f.entity_id, f.k AS fast, s.k AS slow,
   avg(CASE WHEN f.m > s.m THEN 0 ELSE -p.nr END)
     / stddev_samp(CASE WHEN f.m > s.m THEN 0 ELSE -p.nr END) AS sharpe
   FROM {means} f
   JOIN {means} s ON s.entity_id = f.entity_id AND s.t = f.t AND f.k < s.k AND f.k <= {fast}
   JOIN {px} p ON p.entity_id = f.entity_id AND p.t = f.t WHERE p.n > s.k + 2 GROUP BY ALL),
{best} AS (SELECT entity_id, count(*) AS n_trials, var_samp(sharpe) AS var_trials,
   max(sharpe) AS observed_sharpe, arg_max(fast, sharpe) AS fast, arg_max(slow, sharpe) AS slow
   FROM {trial} GROUP BY 1)"""


_REAL_SQL = f"""{b.PRICE_SQL}{b.RETURNS_SQL}, {_sweep_sql('rets')}"""


def _returns(spark, sf_dir):
    return research.returns_of(b.prices(spark, sf_dir))


@query(f"""WITH {_REAL_SQL}
SELECT entity_id, fast, slow, round(sharpe, 6) AS sharpe FROM trial""")
def parameter_sweep(spark, sf_dir):
    """2,691 moving-average pairs on every series, in one shuffle."""
    trials = sweep.sweep(_returns(spark, sf_dir), windows_table(spark, FAST, SLOW), sweep.crossover_rule())
    return trials.join(windows_table(spark, FAST, SLOW), "trial_ord").select(
        "entity_id", "fast", "slow", r6("sharpe").alias("sharpe"))


@query(f"""WITH {_REAL_SQL}
SELECT entity_id, fast, slow, round(sharpe, 6) AS sharpe FROM trial""")
def sweep_from_sql(spark, sf_dir):
    """The same sweep asked for in SQL, as a table function over each series' partition."""
    table_functions.register(spark)
    grid = windows_table(spark, FAST, SLOW)
    params = json.dumps(sweep.parameter_list(grid))
    view = f"returns_{uuid.uuid4().hex}"
    _returns(spark, sf_dir).select("entity_id", "effective_date", "ret").createTempView(view)
    trials = spark.sql(f"""SELECT * FROM sweep(TABLE({view}) PARTITION BY entity_id
        ORDER BY (effective_date), '{params}', 'excess')""")
    spark.catalog.dropTempView(view)  # the plan holds what it named
    return trials.join(grid, "trial_ord").select("entity_id", "fast", "slow", r6("sharpe").alias("sharpe"))


@query(f"""WITH {_REAL_SQL}
SELECT entity_id, n_trials AS evaluated, round(observed_sharpe, 6) AS best_sharpe,
       fast, slow FROM best""")
def best_of_sweep(spark, sf_dir):
    trials = sweep.sweep(_returns(spark, sf_dir), windows_table(spark, FAST, SLOW), sweep.crossover_rule())
    best = sweep.best_trial(trials, windows_table(spark, FAST, SLOW))
    return best.withColumn("best_sharpe", r6("best_sharpe")).drop("trial_ord")


_MOMENTS = """mom AS (SELECT entity_id, any_value(n) AS sample_length,
   avg(pow((ret - mu) / sp, 3)) AS skew, avg(pow((ret - mu) / sp, 4)) AS kurtosis
   FROM rets JOIN (SELECT entity_id, count(*) AS n, avg(ret) AS mu, stddev_pop(ret) AS sp
                   FROM rets GROUP BY 1) USING (entity_id) GROUP BY 1),
results AS (SELECT * FROM best JOIN mom USING (entity_id))"""


def _swept(out):
    return out.select(
        "entity_id", "n_trials", "fast", "slow", r6("best_sharpe").alias("best_sharpe"),
        r6("expected_max_sharpe").alias("expected_max_sharpe"),
        r6("deflated_sharpe").alias("deflated_sharpe"),
        r6("min_backtest_length", 4).alias("min_backtest_length"), "sample_too_short")


@query(f"""WITH {_REAL_SQL}, {_MOMENTS}, {_deflate_sql('results', '''entity_id, n_trials,
  fast, slow, round(observed_sharpe, 6) AS best_sharpe''')} SELECT * FROM d""")
def counted_sweep(spark, sf_dir):
    """Register every trial, evaluate, record, then deflate from the ledger."""
    return _swept(research.counted_sweep(_returns(spark, sf_dir), windows_table(spark, FAST, SLOW),
                                         scratch_path(spark, "ledger"), "real"))


_SMALL = windows_count(4, 12)


@query(f"""WITH {b.PRICE_SQL}{b.RETURNS_SQL}
SELECT entity_id, CAST({2 * _SMALL} AS BIGINT) AS n_trials,
       CAST({2 * _SMALL} AS BIGINT) AS trials_with_outcome, 'searched' AS status
FROM rets GROUP BY 1
UNION ALL SELECT 'first two of ' || min(entity_id), {2 * _SMALL}, 0, 'no trial reported' FROM rets""")
def search_burden(spark, sf_dir):
    """Two searches and a repeat of the first: each series counts both, the repeat nothing.
    A series too short for any parameters keeps its row."""
    from pyspark.sql import Window as W
    returns = _returns(spark, sf_dir).select("entity_id", "effective_date", "ret")
    place = F.row_number().over(W.partitionBy("entity_id").orderBy("effective_date"))
    first = returns.agg(F.min("entity_id")).first()[0]
    short = returns.withColumn("_t", place).where((F.col("_t") <= 2) & (F.col("entity_id") == first)) \
        .drop("_t").withColumn("entity_id", F.lit(f"first two of {first}"))
    every, path = returns.union(short), scratch_path(spark, "burden")
    for search, attempt in (("s1", "first"), ("s2", "second"), ("s1", "first")):
        found = research.counted_sweep(every, windows_table(spark, 4, 12), path, search, attempt=attempt)
    return found.select("entity_id", "n_trials", "trials_with_outcome", "status")


_SHUFFLE_SQL = f"""
by_time AS (SELECT entity_id, effective_date, row_number() OVER
   (PARTITION BY entity_id ORDER BY effective_date) AS pos FROM rets),
by_digest AS (SELECT entity_id, ret, row_number() OVER (PARTITION BY entity_id ORDER BY
   md5('7|' || entity_id || '|' || CAST(effective_date AS VARCHAR))) AS pos FROM rets),
shuffled AS (SELECT t.entity_id, t.effective_date, d.ret FROM by_time t JOIN by_digest d USING (entity_id, pos))"""


@query(f"""WITH {b.PRICE_SQL}{b.RETURNS_SQL}, {_SHUFFLE_SQL}
SELECT entity_id, effective_date, round(ret, 6) AS ret FROM shuffled""")
def reshuffled_returns(spark, sf_dir):
    return sweep.reshuffle(_returns(spark, sf_dir), 7).select(
        "entity_id", "effective_date", r6("ret").alias("ret"))


@query(f"""WITH {b.PRICE_SQL}{b.RETURNS_SQL}, {_SHUFFLE_SQL},
{_sweep_sql('rets', '_real')}, {_sweep_sql('shuffled', '_null')},
{_MOMENTS.replace('results AS (SELECT * FROM best JOIN mom USING (entity_id))',
                  'res_real AS (SELECT * FROM best_real JOIN mom USING (entity_id)), '
                  'res_null AS (SELECT * FROM best_null JOIN mom USING (entity_id))')},
{_deflate_sql('res_real', 'entity_id, n_trials', '_r')}, {_deflate_sql('res_null', 'entity_id, n_trials', '_n')}
SELECT entity_id, round(r.observed_sharpe, 6) AS real_best, round(n.observed_sharpe, 6) AS null_best,
       d_r.n_trials AS real_trials, d_n.n_trials AS null_trials, 'searched' AS real_status,
       'searched' AS null_status, d_r.deflated_sharpe AS real_deflated,
       d_n.deflated_sharpe AS null_deflated,
       round(n.observed_sharpe / r.observed_sharpe, 4) AS null_as_fraction_of_real,
       n.observed_sharpe >= 0.8 * r.observed_sharpe AS indistinguishable_from_noise,
       CASE WHEN n.observed_sharpe >= 0.8 * r.observed_sharpe THEN 'NOISE' ELSE 'EXCEEDS NULL' END
         AS verdict
FROM best_real r JOIN best_null n USING (entity_id) JOIN d_r USING (entity_id)
  JOIN d_n USING (entity_id)""")
def null_comparison(spark, sf_dir):
    """The same counted search on real and on reshuffled returns."""
    returns = _returns(spark, sf_dir)
    path = scratch_path(spark, "ledger")
    real = research.counted_sweep(returns, windows_table(spark, FAST, SLOW), path, "real")
    null = research.null_benchmark(returns, windows_table(spark, FAST, SLOW), path, "null", seed=7)
    return sweep.compare_to_null(real, null).withColumns({
        **{c: r6(c) for c in ("real_best", "null_best", "real_deflated", "null_deflated")},
        "null_as_fraction_of_real": r6("null_as_fraction_of_real", 4)})


_SUMMARY_SQL = f"""{TIMING_SQL}, curve AS (
  SELECT *, exp(sum(ln(1 + strategy)) OVER (PARTITION BY entity_id, win ORDER BY effective_date))
         AS equity FROM rule),
fall AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY entity_id, win
         ORDER BY effective_date)) - 1 AS fall FROM curve),
fam AS (SELECT entity_id, win, count(*) AS n_periods, avg(strategy) / nullif(stddev_pop(strategy), 0) AS sharpe,
        -least(0, min(fall)) AS mdd, max_by(equity, effective_date) - 1 AS total, avg(signal) AS exposure
        FROM fall GROUP BY ALL)"""


@query(f"""WITH {_SUMMARY_SQL}
SELECT entity_id, win AS "window", n_periods, round(sharpe, 6) AS sharpe_per_period,
       round(mdd, 6) AS max_drawdown, round(total, 6) AS total_return, round(exposure, 6) AS exposure,
       round(sharpe * sqrt(252), 6) AS sharpe_annualised FROM fam""")
def timing_summary(spark, sf_dir):
    out = sweep.timing_summary(sweep.timing_returns(b.prices(spark, sf_dir), WINDOWS))
    return out.withColumns({c: r6(c) for c in (
        "sharpe_per_period", "max_drawdown", "total_return", "exposure", "sharpe_annualised")})


@query(f"""WITH {_SUMMARY_SQL}, results AS (
  SELECT entity_id, v.n AS n_trials, var_samp(sharpe) AS var_trials, max(sharpe) AS observed_sharpe,
         arg_max(win, sharpe) AS best_window, arg_max(n_periods, sharpe) AS sample_length,
         0.0::DOUBLE AS skew, 3.0::DOUBLE AS kurtosis
  FROM fam, (VALUES (1), (9), (2691)) v(n) GROUP BY ALL),
{_deflate_sql('results', 'entity_id, CAST(n_trials AS BIGINT) AS n_trials, best_window')}
SELECT entity_id, n_trials, best_window, deflated_sharpe FROM d""")
def timing_family(spark, sf_dir):
    """What committing to one window buys over having picked it from nine, or 2,691."""
    return research.timing_family(b.prices(spark, sf_dir), WINDOWS, [1, 9, 2691]).select(
        "entity_id", "n_trials", "best_window", r6("deflated_sharpe").alias("deflated_sharpe"))


@query(f"""WITH {b.PRICE_SQL}, cut AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY effective_date) AS t,
         count(*) FILTER (effective_date < DATE '2000-01-01') OVER (PARTITION BY entity_id) AS nb
  FROM price),
kept AS (SELECT entity_id, effective_date, value FROM cut WHERE t > nb - 200),
base AS (SELECT *, row_number() OVER w AS t, lead(value) OVER w / value - 1 AS market,
         avg(value) OVER (PARTITION BY entity_id ORDER BY effective_date
                          ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS m
         FROM kept WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date)),
r AS (SELECT *, CASE WHEN value > m THEN market ELSE 0 END AS strategy FROM base
      WHERE t >= 200 AND market IS NOT NULL),
e AS (SELECT *, exp(sum(ln(1 + strategy)) OVER w) AS es, exp(sum(ln(1 + market)) OVER w) AS em
      FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date)),
f AS (SELECT *, es / greatest(1, max(es) OVER w) - 1 AS fs, em / greatest(1, max(em) OVER w) - 1 AS fm
      FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date)),
s AS (SELECT entity_id, count(*) AS n_periods, avg(strategy) / stddev_pop(strategy) * sqrt(252) AS ss,
      avg(market) / stddev_pop(market) * sqrt(252) AS sm, -least(0, min(fs)) AS ds,
      -least(0, min(fm)) AS dm FROM f GROUP BY 1)
SELECT entity_id, n_periods, round(ss, 6) AS rule_sharpe, round(ds, 6) AS rule_drawdown,
       round(sm, 6) AS market_sharpe, round(dm, 6) AS market_drawdown,
       ds < dm * 2 / 3 AS drawdown_held, ss >= sm - 0.05 AS sharpe_held FROM s""")
def timing_on_holdout(spark, sf_dir):
    out = research.timing_on_holdout(b.prices(spark, sf_dir), 200, "2000-01-01")
    return out.withColumns({c: r6(c) for c in ("rule_sharpe", "rule_drawdown", "market_sharpe",
                                               "market_drawdown")})


# --- holdouts, evaluations, runs ------------------------------------------------------------------

@query(f"""WITH {b.HOLDOUT_SQL}
SELECT r.dataset_id, user_id, r.start_date, r.end_date,
       coalesce(r.start_date <= p.end_date AND r.end_date >= p.start_date, false) AS refused
FROM requests r LEFT JOIN periods p USING (dataset_id)""")
def holdout_overlap(spark, sf_dir):
    out = ledger.overlapping_requests(b.requests(spark, sf_dir), b.holdout_periods(spark, sf_dir))
    return out.select("dataset_id", "user_id", "start_date", "end_date", "refused")


@query(f"""WITH {b.HOLDOUT_SQL}, ranges AS (
  SELECT dataset_id, min(start_date) AS start_date, max(end_date) AS end_date FROM requests GROUP BY 1)
SELECT g.dataset_id, g.start_date, g.end_date,
       coalesce(g.start_date <= p.end_date AND g.end_date >= p.start_date, false) AS refused
FROM ranges g LEFT JOIN periods p USING (dataset_id)""")
def guarded_series(spark, sf_dir):
    """The range each dataset's data really spans, checked against its holdout."""
    reads = b.requests(spark, sf_dir).select("dataset_id", F.explode(
        F.array("start_date", "end_date")).alias("effective_date"))
    out = ledger.overlapping_requests(ledger.series_ranges(reads), b.holdout_periods(spark, sf_dir))
    return out.select("dataset_id", "start_date", "end_date", "refused")


@query(f"""WITH {b.EVALUATIONS_SQL}
SELECT dataset_id, strategy_family, count(*) AS evaluations, count(*) > 1 AS exhausted,
       CASE WHEN count(*) >= 4 THEN 'exhausted' WHEN count(*) >= 2 THEN 'caution' ELSE 'none' END
         AS warning FROM evaluations GROUP BY 1, 2""")
def holdout_exhaustion(spark, sf_dir):
    return ledger.holdout_exhaustion(b.evaluations(spark, sf_dir))


@query(f"""WITH {b.EVALUATIONS_SQL}
SELECT registration_id, 'unregistered' AS problem, count(*) AS looks FROM evaluations
WHERE registration_id NOT IN (SELECT registration_id FROM registrations) GROUP BY 1
UNION ALL SELECT registration_id, 'spent more than once', count(*) FROM evaluations
GROUP BY 1 HAVING count(*) > 1""")
def evaluation_audit(spark, sf_dir):
    looks = b.evaluations(spark, sf_dir)
    missing = ledger.unregistered_evaluations(looks, b.registrations(spark, sf_dir))
    return (missing.groupBy("registration_id").agg(F.count(F.lit(1)).alias("looks"))
            .withColumn("problem", F.lit("unregistered"))
            .unionByName(ledger.double_spent(looks)
                         .withColumn("problem", F.lit("spent more than once"))))


@query("""SELECT CASE WHEN length(trim(p_type)) = 0 THEN 'strategy_family is required'
    WHEN length(trim(p_name)) < 10 THEN 'expected_result is not falsifiable' END AS reason,
    count(*) AS registrations FROM part GROUP BY 1""")
def registration_validation(spark, sf_dir):
    """Pre-registrations must predict something: part names stand in for predictions."""
    rows = b.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("strategy_family"), F.col("p_brand").alias("hypothesis"),
        F.col("p_name").alias("expected_result"))
    good, bad = validation.split_registrations(rows)
    reason = F.lit(None).cast("string")
    return (good.withColumn("reason", reason).unionByName(bad).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("registrations")))


@query(f"""WITH {b.RUNS_SQL}
SELECT run_id, strategy, started_at, outcome FROM runs
WHERE strategy = 'click' AND uses_momentum AND started_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND started_at <= TIMESTAMP '2024-01-25 00:00:00' AND outcome = 'completed' ORDER BY started_at""")
def run_log_search(spark, sf_dir):
    return ledger.search_runs(b.runs(spark, sf_dir), "click", "momentum", "2024-01-05 00:00:00",
                              "2024-01-25 00:00:00", "completed").select(
        "run_id", "strategy", "started_at", "outcome")


@query(f"""WITH {b.TRIALS_SQL}
SELECT trial_id, dataset_id, search_id, started_at, sharpe FROM trials
WHERE dataset_id = 'purchase' ORDER BY started_at""")
def ledger_records(spark, sf_dir):
    return ledger.records(b.trials(spark, sf_dir), "started_at", dataset_id="purchase")


@query(f"""WITH {b.TRIALS_SQL}, r AS (
  SELECT event_type AS dataset_id, count(*) AS n_runs FROM events GROUP BY 1)
SELECT dataset_id, count(*) AS n_trials, any_value(n_runs) AS n_runs,
       round((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(min(started_at))) / 86400e6, 6)
         AS age_days FROM trials JOIN r USING (dataset_id) GROUP BY 1""")
def ledger_provenance(spark, sf_dir):
    return ledger.ledger_provenance(b.trials(spark, sf_dir), b.runs(spark, sf_dir), "2024-03-01 00:00:00"
                                    ).withColumn("age_days", r6("age_days"))


@query("""WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderdate AS DATE) AS s FROM orders),
r AS (SELECT p_name AS key, p_brand || '|' || p_type AS said FROM part)
SELECT key, 'second holdout period' AS rule FROM p GROUP BY 1 HAVING min(s) <> max(s)
UNION ALL SELECT key, 'edited registration' FROM r GROUP BY 1 HAVING min(said) <> max(said)""")
def holdout_violations(spark, sf_dir):
    """Orders stand in for holdout periods of a customer, parts for registrations by name."""
    day = F.col("o_orderdate").cast("date")
    periods = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset_id"), day.alias("start_date"),
        F.date_add(day, 30).alias("end_date"))
    registrations = b.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("registration_id"), F.col("p_brand").alias("dataset_id"),
        F.col("p_type").alias("strategy_family"), F.lit("h").alias("hypothesis"),
        F.lit("e").alias("expected_result"))
    return ledger.holdout_violations(periods, registrations)


@query("""WITH log AS (
  SELECT CAST(event_id // 3 AS VARCHAR) AS run_id, event_type = 'click' AS started,
         CAST(user_id % 2 AS VARCHAR) AS identity,
         CASE WHEN event_type <> 'click' THEN CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) END AS h
  FROM events),
per AS (SELECT run_id, count(*) FILTER (started) AS starts, min(identity) <> max(identity) AS moved,
               min(h) <> max(h) AS rewritten, min(h) IS NOT NULL AS has FROM log GROUP BY 1)
SELECT run_id, 'changed identity' AS rule FROM per WHERE moved
UNION ALL SELECT run_id, 'result rewritten' FROM per WHERE rewritten
UNION ALL SELECT run_id, 'result without start' FROM per WHERE has AND starts = 0""")
def run_violations(spark, sf_dir):
    """Three events stand in for the log of one run: clicks start it, others report."""
    started = F.col("event_type") == "click"
    log = b.table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 3).cast("string").alias("run_id"),
        F.when(started, "started").otherwise("completed").alias("kind"),
        (F.col("user_id") % 2).cast("string").alias("identity"),
        F.when(~started, F.floor(F.col("value") / 20).cast("string")).alias("result_hash"))
    return ledger.run_violations(log)
