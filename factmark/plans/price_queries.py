"""Factors, risk and sizing on the driver's tables."""
from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import allocation, factors, risk, sweep, universe
from . import bindings as b
from .registry import query, r6

_OVER = "WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date)"
SPLIT = "1999-06-30"


def _factor(frame):
    return frame.select("entity_id", "effective_date", r6("factor").alias("factor"))


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}
SELECT entity_id, effective_date, round(lag(value, 21) OVER w / lag(value, 252) OVER w - 1, 6)
       AS factor FROM price {_OVER}""")
def momentum(spark, sf_dir):
    return _factor(factors.momentum(b.supplier_prices(spark, sf_dir)))


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}
SELECT entity_id, effective_date, round(-(value / lag(value, 21) OVER w - 1), 6) AS factor
FROM price {_OVER}""")
def reversal(spark, sf_dir):
    return _factor(factors.reversal(b.supplier_prices(spark, sf_dir)))


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}, logged AS (
  SELECT entity_id, effective_date, ln(value / lag(value) OVER w) AS r FROM price {_OVER})
SELECT entity_id, effective_date, round(CASE WHEN count(r) OVER v = 21
       THEN stddev_samp(r) OVER v * sqrt(252) END, 6) AS factor FROM logged
WINDOW v AS (PARTITION BY entity_id ORDER BY effective_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
""")
def realised_volatility(spark, sf_dir):
    return _factor(factors.realised_volatility(b.supplier_prices(spark, sf_dir)))


@query(f"""WITH {b.PRICE_SQL}
SELECT entity_id, effective_date, round(value / lag(value) OVER w - 1, 6) AS ret
FROM price {_OVER}""")
def simple_returns(spark, sf_dir):
    return factors.simple_returns(b.prices(spark, sf_dir)).select(
        "entity_id", "effective_date", r6("ret").alias("ret"))


@query(f"""WITH {b.PRICE_SQL}{b.RETURNS_SQL}
SELECT entity_id, effective_date, round(exp(sum(ln(1 + ret)) OVER w), 6) AS price
FROM rets {_OVER}""")
def cumulative_price(spark, sf_dir):
    returns = factors.simple_returns(b.prices(spark, sf_dir)).where("ret IS NOT NULL")
    return factors.cumulative_price(returns).select("entity_id", "effective_date",
                                                    r6("price").alias("price"))


@query("""
SELECT c_mktsegment AS entity_id, c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6)
       AS factor FROM customer""")
def market_size(spark, sf_dir):
    caps = b.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("entity_id"), "c_custkey", F.col("c_acctbal").alias("value"))
    return factors.market_size(caps).select("entity_id", "c_custkey", r6("factor").alias("factor"))


_CAPS_SQL = """caps AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderdate AS DATE) AS effective_date,
         sum(o_totalprice) AS cap FROM orders GROUP BY 1, 2)"""


def _caps(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.to_date("o_orderdate").alias("effective_date")).agg(F.sum("o_totalprice").alias("value"))


_BOOK_SQL = f"""{b.FIRSTS_SQL}, {_CAPS_SQL},
known AS (
  SELECT c.entity_id, c.effective_date, c.cap, f.effective_date AS period, f.value,
         row_number() OVER (PARTITION BY c.entity_id, c.effective_date
                            ORDER BY f.effective_date DESC) AS r
  FROM caps c LEFT JOIN firsts f ON f.entity_id = c.entity_id AND f.field = 'line_1'
       AND f.knowledge_date <= c.effective_date)"""


@query(f"""WITH {_BOOK_SQL}
SELECT entity_id, effective_date, period, round(value / cap, 6) AS factor FROM known WHERE r = 1""")
def book_to_market(spark, sf_dir):
    """As-of join on two levels: latest period known, then that period's first report."""
    from ..operators import bitemporal
    first = bitemporal.first_reports(b.facts(spark, sf_dir).where("field = 'line_1'"))
    return factors.book_to_market(_caps(spark, sf_dir), first).withColumn("factor", r6("factor"))


def _demeaned(panel):
    """A factor that reads the whole series: what the causality check must catch."""
    mean = panel.groupBy("entity_id").agg(F.avg("value").alias("_mean"))
    return panel.join(mean, "entity_id").withColumn("factor", F.col("value") - F.col("_mean"))


@query(f"""WITH {b.PRICE_SQL}, m AS (
  SELECT *, lag(value, 21) OVER w / lag(value, 252) OVER w - 1 AS factor FROM price {_OVER}),
head AS (SELECT * FROM m WHERE effective_date <= DATE '{SPLIT}')
SELECT entity_id, 'momentum' AS factor_name, count(*) AS head_rows, count(factor) AS compared,
       CAST(0 AS BIGINT) AS moved, count(factor) = 0 AS vacuous FROM head GROUP BY 1
UNION ALL
SELECT entity_id, 'whole_series_mean', count(*), count(*), count(*), false FROM head GROUP BY 1""")
def causality_check(spark, sf_dir):
    panel = b.prices(spark, sf_dir)
    columns = ["entity_id", "factor_name", "head_rows", "compared", "moved", "vacuous"]
    checks = [factors.causality_check(fn, panel, SPLIT).withColumn("factor_name", F.lit(name))
              .select(*columns) for name, fn in (("momentum", factors.momentum),
                                                 ("whole_series_mean", _demeaned))]
    return checks[0].unionByName(checks[1])


# The factor registry rows expected beside the factor's coverage.
@query(f"""WITH {b.SUPPLIER_PRICE_SQL}, {_BOOK_SQL}, m AS (
  SELECT lag(value, 252) OVER w AS a, lag(value, 21) OVER w AS b, row_number() OVER w AS t
  FROM price {_OVER})
SELECT 'momentum' AS name, 'positive' AS direction, count(a) AS values FROM m
UNION ALL SELECT 'reversal', 'positive', count(b) FROM m
UNION ALL SELECT 'volatility', 'negative', count(*) FROM m WHERE t > 21
UNION ALL SELECT 'size', 'negative', count(*) FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'book_to_market', 'positive', count(value / cap) FROM known WHERE r = 1""")
def factor_registry(spark, sf_dir):
    """Registry metadata joined to how many values each registered factor produced."""
    from ..operators import bitemporal
    panel = b.supplier_prices(spark, sf_dir)
    first = bitemporal.first_reports(b.facts(spark, sf_dir).where("field = 'line_1'"))
    made = {"momentum": factors.momentum(panel), "reversal": factors.reversal(panel),
            "volatility": factors.realised_volatility(panel),
            "size": factors.market_size(b.table(spark, sf_dir, "customer").select(
                F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("value"))),
            "book_to_market": factors.book_to_market(_caps(spark, sf_dir), first)}
    counts = [rows.agg(F.count("factor").alias("values")).withColumn("name", F.lit(name))
              for name, rows in made.items()]
    every = counts[0]
    for other in counts[1:]:
        every = every.unionByName(other)
    return factors.registry(spark).join(every, "name", "left").select("name", "direction", "values")


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}, f AS (
  SELECT *, lag(value, 5) OVER w / lag(value, 60) OVER w - 1 AS factor,
         lead(value) OVER w / value - 1 AS next_ret FROM price {_OVER}),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY effective_date ORDER BY factor, entity_id) - 1) * 5
         // count(*) OVER (PARTITION BY effective_date) AS bucket
  FROM f WHERE factor IS NOT NULL AND next_ret IS NOT NULL)
SELECT effective_date, count(*) AS names,
       round(avg(next_ret) FILTER (bucket = 4) - avg(next_ret) FILTER (bucket = 0), 6) AS long_short,
       round(avg(next_ret), 6) AS equal_weight FROM ranked GROUP BY 1""")
def factor_portfolio(spark, sf_dir):
    """Long the top momentum bucket, short the bottom, each date, against equal weight."""
    panel = factors.momentum(b.supplier_prices(spark, sf_dir), 60, 5)
    out = universe.factor_portfolio(panel)
    return out.withColumns({c: r6(c) for c in ("long_short", "equal_weight")})


# --- risk ---------------------------------------------------------------------------

_DRAW_SQL = f"""{b.SUPPLIER_PRICE_SQL}, dd AS (
  SELECT *, value / max(value) OVER w - 1 AS drawdown, value / lag(value) OVER w - 1 AS ret
  FROM price {_OVER})"""


@query(f"""WITH {_DRAW_SQL}
SELECT entity_id, effective_date, round(drawdown, 6) AS drawdown FROM dd""")
def drawdown_series(spark, sf_dir):
    return risk.drawdown_series(b.supplier_prices(spark, sf_dir)).select(
        "entity_id", "effective_date", r6("drawdown").alias("drawdown"))


@query(f"""WITH {_DRAW_SQL}
SELECT entity_id, effective_date, round(greatest(0.25, 1 + drawdown / 0.5), 6) AS keep,
       round(CASE WHEN drawdown = 0 THEN 0 ELSE -ln(1 + drawdown) / ln(1.1) END, 6) AS recovery
FROM dd""")
def risk_controls(spark, sf_dir):
    """Exposure throttle and recovery time along each drawdown path."""
    falls = risk.drawdown_series(b.supplier_prices(spark, sf_dir))
    return risk.risk_controls(falls, 0.5, 0.1, 0.25).select(
        "entity_id", "effective_date", r6("keep").alias("keep"), r6("recovery").alias("recovery"))


@query(f"""WITH {_DRAW_SQL}
SELECT entity_id, round(-min(drawdown), 6) AS max_drawdown,
       round(100 * sqrt(avg(drawdown * drawdown)), 6) AS ulcer_index FROM dd GROUP BY 1""")
def max_drawdown_and_ulcer(spark, sf_dir):
    falls = risk.drawdown_series(b.supplier_prices(spark, sf_dir))
    d = F.col("drawdown")
    return falls.groupBy("entity_id").agg(r6(-F.min(d)).alias("max_drawdown"),
                                          r6(100 * F.sqrt(F.avg(d * d))).alias("ulcer_index"))


@query(f"""WITH {_DRAW_SQL}, p AS (
  SELECT entity_id, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS sd,
         -min(drawdown) AS mdd, 100 * sqrt(avg(drawdown * drawdown)) AS ulcer,
         greatest(0, -quantile_cont(ret, 0.05)) AS v95, greatest(0, -quantile_cont(ret, 0.01)) AS v99
  FROM dd GROUP BY 1)
SELECT entity_id, n AS n_observations, round(mdd, 6) AS max_drawdown, round(ulcer, 6) AS ulcer_index,
       round(sd, 6) AS volatility_per_period, round(sd * sqrt(252), 6) AS volatility_annualised,
       round(m / sd, 6) AS sharpe_per_period, round(m / sd * sqrt(252), 6) AS sharpe_annualised,
       round(v95, 6) AS var_95, round(v99, 6) AS var_99 FROM p WHERE n >= 2""")
def risk_metrics(spark, sf_dir):
    out = risk.risk_metrics(b.supplier_prices(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("entity_id",
                                                                      "n_observations")})


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}{b.RETURNS_SQL}
SELECT 0.95::DOUBLE AS confidence, round(greatest(0, -quantile_cont(ret, 0.05)), 6) AS var FROM rets
UNION ALL SELECT 0.99, round(greatest(0, -quantile_cont(ret, 0.01)), 6) FROM rets""")
def historical_var(spark, sf_dir):
    """VaR of all returns pooled: one group, ranked across tasks."""
    returns = factors.simple_returns(b.supplier_prices(spark, sf_dir))
    return risk.historical_var(returns, [0.95, 0.99]).withColumn("var", r6("var"))


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}{b.RETURNS_SQL}
SELECT entity_id, count(*) AS n, round(avg(ret) / stddev_samp(ret), 6) AS sharpe
FROM rets GROUP BY 1""")
def per_period_sharpe(spark, sf_dir):
    return risk.per_period_sharpe(b.supplier_prices(spark, sf_dir)).withColumn(
        "sharpe", r6("sharpe"))


_OUTCOME_SQL = f"""{b.PATHS_SQL}, falls AS (
  SELECT *, value / max(value) OVER (PARTITION BY path_id ORDER BY step) - 1 AS drawdown FROM paths),
outcomes AS (
  SELECT path_id, max_by(value, step) / 100 - 1 AS total, max(step) AS horizon,
         -min(drawdown) AS mdd, max_by(value, step) <= 0 AS ruined FROM falls GROUP BY 1),
a AS (SELECT *, pow(1 + total, 252.0 / horizon) - 1 AS ann FROM outcomes),
q AS (SELECT quantile_cont(total, 0.05) AS q05, quantile_cont(total, 0.01) AS q01 FROM a)"""


@query(f"""WITH {_OUTCOME_SQL}
SELECT count(*) AS n_paths, round(avg(ann), 6) AS mean_annualised_return,
       round(quantile_cont(ann, 0.5), 6) AS median_annualised_return,
       round(stddev_samp(ann), 6) AS terminal_dispersion,
       round(avg(CASE WHEN total < 0 THEN 1.0 ELSE 0.0 END), 6) AS probability_of_loss,
       round(avg(CASE WHEN ruined THEN 1.0 ELSE 0.0 END), 6) AS ruin_probability,
       round(-any_value(q05), 6) AS var_95, round(-any_value(q01), 6) AS var_99,
       round(-avg(total) FILTER (total <= q05), 6) AS expected_shortfall_95,
       round(-avg(total) FILTER (total <= q01), 6) AS expected_shortfall_99,
       round(avg(mdd), 6) AS mean_max_drawdown,
       round(quantile_cont(mdd, 0.95), 6) AS max_drawdown_95,
       round(quantile_cont(mdd, 0.99), 6) AS max_drawdown_99,
       round(min(total), 6) AS worst_terminal_return, round(max(total), 6) AS best_terminal_return
FROM a, q""")
def path_statistics(spark, sf_dir):
    out = risk.path_statistics(risk.path_outcomes(b.paths(spark, sf_dir), 100.0))
    return out.withColumns({c: r6(c) for c in out.columns if c != "n_paths"})


@query(f"""WITH {_OUTCOME_SQL}
SELECT path_id, round(ann, 6) AS annualised_return FROM a""")
def annualised_returns(spark, sf_dir):
    outcomes = risk.path_outcomes(b.paths(spark, sf_dir), 100.0)
    return outcomes.select("path_id", r6(scalars.annualise_return(
        F.col("total_return"), F.col("horizon"))).alias("annualised_return"))


# --- sizing -----------------------------------------------------------------------------

@query(f"""WITH {b.BETS_SQL}, p AS (
  SELECT strategy, count(*) AS n_bets, avg(CAST(win AS INTEGER)) AS p,
         avg(amount) FILTER (win) / avg(amount) FILTER (NOT win) AS b FROM bets GROUP BY 1),
k AS (SELECT *, (b * p - (1 - p)) / b AS f, greatest(0, 0.5 * (b * p - (1 - p)) / b) AS h FROM p)
SELECT strategy, n_bets, round(p, 6) AS win_prob, round(b, 6) AS win_loss_ratio,
       round(f, 6) AS kelly, round(0.5 * f, 6) AS fractional_kelly,
       round(p * ln(1 + h * b) + (1 - p) * ln(1 - h), 6) AS growth FROM k""")
def bet_kelly(spark, sf_dir):
    out = allocation.bet_kelly(b.bets(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("strategy", "n_bets")})


# Three assets per portfolio, so the SQL twin can invert the covariance by cofactors.
_MOMENT_SQL = f"""{b.PORTFOLIO_SQL},
full_dates AS (SELECT portfolio_id, effective_date FROM asset_rets GROUP BY ALL HAVING count(*) = 3),
x AS (SELECT portfolio_id, effective_date, max(ret) FILTER (entity_id = 'F') AS f,
             max(ret) FILTER (entity_id = 'O') AS o, max(ret) FILTER (entity_id = 'P') AS p
      FROM asset_rets JOIN full_dates USING (portfolio_id, effective_date) GROUP BY ALL),
c AS (SELECT portfolio_id, count(*) AS n, avg(f) AS mf, avg(o) AS mo, avg(p) AS mp,
             var_samp(f) AS a, covar_samp(f, o) AS b, covar_samp(f, p) AS c, var_samp(o) AS d,
             covar_samp(o, p) AS e, var_samp(p) AS g FROM x GROUP BY 1),
inv AS (SELECT *, a * (d * g - e * e) - b * (b * g - c * e) + c * (b * e - c * d) AS det FROM c),
w AS (SELECT *, ((d*g - e*e) * mf + (c*e - b*g) * mo + (b*e - c*d) * mp) / det AS wf,
                ((c*e - b*g) * mf + (a*g - c*c) * mo + (b*c - a*e) * mp) / det AS wo,
                ((b*e - c*d) * mf + (b*c - a*e) * mo + (a*d - b*b) * mp) / det AS wp FROM inv)"""


@query(f"""WITH {_MOMENT_SQL}, long AS (
  SELECT portfolio_id, n, 'F' AS entity_id, mf AS mean, a AS variance, wf AS weight, wf, wo, wp FROM w
  UNION ALL SELECT portfolio_id, n, 'O', mo, d, wo, wf, wo, wp FROM w
  UNION ALL SELECT portfolio_id, n, 'P', mp, g, wp, wf, wo, wp FROM w)
SELECT portfolio_id, entity_id, round(weight * 0.5, 6) AS weight,
       round(1 - 0.5 * (wf + wo + wp), 6) AS cash_weight,
       round(0.5 * (abs(wf) + abs(wo) + abs(wp)), 6) AS gross_leverage,
       1 - 0.5 * (wf + wo + wp) < 0 AS is_levered FROM long""")
def kelly_portfolio(spark, sf_dir):
    moments = allocation.return_moments(b.portfolio_returns(spark, sf_dir))
    return allocation.kelly_weights(moments, 0.5).withColumns(
        {c: r6(c) for c in ("weight", "cash_weight", "gross_leverage")})


@query(f"""WITH {_MOMENT_SQL}
SELECT portfolio_id, n AS n_dates, 'solved' AS status, round(mf + mo + mp, 6) AS mean_sum,
       round(a + d + g, 6) AS variance_sum, round(b + c + e, 6) AS covariance_sum FROM w""")
def portfolio_moments(spark, sf_dir):
    m = allocation.return_moments(b.portfolio_returns(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    at = lambda i: F.element_at("covariance", i)
    trace = at(1) + at(5) + at(9)
    return m.select("portfolio_id", "n_dates", "status", r6(total("mean")).alias("mean_sum"),
                    r6(trace).alias("variance_sum"),
                    r6((total("covariance") - trace) / 2).alias("covariance_sum"))


_SCENARIO_VALUES = ", ".join(f"('{n}', {m}::DOUBLE, {v}::DOUBLE)"
                             for n, m, v in allocation.SCENARIOS)


@query(f"""WITH {_MOMENT_SQL}, s(scenario, m, v) AS (VALUES {_SCENARIO_VALUES}),
base AS (SELECT portfolio_id, 0.5 * (wf*mf + wo*mo + wp*mp) AS mu,
  0.25 * (wf*wf*a + wo*wo*d + wp*wp*g + 2 * (wf*wo*b + wf*wp*c + wo*wp*e)) AS var FROM w)
SELECT portfolio_id, scenario, round(mu * m, 6) AS mean_return, round(sqrt(var) * v, 6) AS volatility
FROM base, s""")
def scenario_shocks(spark, sf_dir):
    moments = allocation.return_moments(b.portfolio_returns(spark, sf_dir))
    return allocation.scenario_shocks(moments).withColumns(
        {c: r6(c) for c in ("mean_return", "volatility")})


# --- timing rules and the fixed-size backtest ---------------------------------------------

WINDOWS = [50, 100, 125, 150, 175, 200, 225, 250, 300]


def _timing_sql(windows):
    means = ", ".join(f"avg(value) OVER (PARTITION BY entity_id ORDER BY effective_date "
                      f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m{w}" for w in windows)
    parts = " UNION ALL ".join(
        f"SELECT entity_id, {w} AS win, effective_date, market, "
        f"CASE WHEN value > m{w} THEN 1.0::DOUBLE ELSE 0 END AS signal FROM base "
        f"WHERE t >= {w} AND market IS NOT NULL" for w in windows)
    return f"""{b.PRICE_SQL}, base AS (
  SELECT *, row_number() OVER w AS t, lead(value) OVER w / value - 1 AS market, {means}
  FROM price {_OVER}),
rule AS (SELECT *, signal * market AS strategy FROM ({parts}))"""


TIMING_SQL = _timing_sql(WINDOWS)


@query(f"""WITH {TIMING_SQL}
SELECT entity_id, effective_date, round(strategy, 6) + 0.0 AS strategy, round(market, 6) + 0.0 AS market,
       signal FROM rule WHERE win = 200""")
def timing_rule(spark, sf_dir):
    rows = sweep.timing_returns(b.prices(spark, sf_dir), [200])
    return rows.select("entity_id", "effective_date", r6("strategy").alias("strategy"),
                       r6("market").alias("market"), "signal")


@query(f"""WITH {b.PRICE_SQL}, s AS (
  SELECT *, CASE WHEN lag(value, 5) OVER w / lag(value, 60) OVER w - 1 > 0 THEN 100.0::DOUBLE ELSE 0 END
         AS position, coalesce(value - lag(value) OVER w, 0) AS move FROM price {_OVER}),
tr AS (SELECT *, coalesce(lag(position) OVER w, 0) AS before FROM s {_OVER}),
f AS (SELECT *, position - before AS traded, abs(position - before) * value * 0.0005 AS fee,
             before * move AS pnl FROM tr)
SELECT entity_id, effective_date, position, traded, round(fee, 6) AS fee,
       round((1000000 + sum(pnl - fee) OVER w) / 999983, 6) AS equity FROM f {_OVER}""")
def signal_backtest(spark, sf_dir):
    return sweep.signal_backtest(b.prices(spark, sf_dir)).select(
        "entity_id", "effective_date", "position", "traded", r6("fee").alias("fee"),
        r6(F.col("equity") / 999983).alias("equity"))


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}{b.RETURNS_SQL}, m AS (
  SELECT entity_id, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp
  FROM rets GROUP BY 1)
SELECT entity_id, any_value(n) AS n_observations, round(any_value(mu), 6) AS mean,
       round(any_value(sd), 6) AS sd, round(avg(pow((ret - mu) / sp, 3)), 6) AS skew,
       round(avg(pow((ret - mu) / sp, 4)), 6) AS kurtosis
FROM rets JOIN m USING (entity_id) GROUP BY 1""")
def return_moments(spark, sf_dir):
    out = sweep.return_moments(factors.simple_returns(b.supplier_prices(spark, sf_dir)))
    return out.withColumns({c: r6(c) for c in ("mean", "sd", "skew", "kurtosis")})
