"""Views over the driver's tables, each in a DataFrame and an SQL form.

The SQL forms are CTE bodies shared by the oracle queries.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.bitemporal import mark_restatements
from ..operators.folds import index_labels
from ..operators.validation import split_facts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- facts: an order line is a fact about its customer, known when it shipped ------

FACT_IN_SQL = """
fact_in AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id,
         'line_' || CAST(l_linenumber AS VARCHAR) AS field, l_extendedprice AS value,
         CAST(o_orderdate AS DATE) AS effective_date, CAST(l_shipdate AS DATE) AS knowledge_date,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS version_number
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
FACTS_SQL = FACT_IN_SQL + """,
facts AS (SELECT * FROM fact_in WHERE knowledge_date >= effective_date)"""
FIRSTS_SQL = FACTS_SQL + """,
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field, effective_date
                 ORDER BY knowledge_date, version_number, value) AS rn FROM facts) WHERE rn = 1)"""
MARKED_SQL = FACTS_SQL + """,
batch_first AS (
  SELECT entity_id, field, effective_date, version_number,
         first(value ORDER BY knowledge_date, value) AS v FROM facts GROUP BY ALL),
marked AS (
  SELECT f.*, f.value <> coalesce(s.v, b.v) AS is_restatement, coalesce(s.v, b.v) AS baseline,
         s.v IS NOT NULL AS already_stored
  FROM facts f
  JOIN batch_first b USING (entity_id, field, effective_date, version_number)
  LEFT JOIN batch_first s ON s.entity_id = f.entity_id AND s.field = f.field
       AND s.effective_date = f.effective_date AND s.version_number = 1
       AND f.version_number = 2)"""


def fact_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("entity_id"),
        F.to_date("o_orderdate").alias("effective_date"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("field"),
        F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("knowledge_date"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("version_number"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        "entity_id", "field", "value", "effective_date", "knowledge_date", "version_number",
        F.lit("orders").alias("source"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_facts(fact_input(spark, sf_dir))[0]


def loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two loads the facts arrive in."""
    every = facts(spark, sf_dir)
    return every.where("version_number = 1"), every.where("version_number = 2")


def marked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both loads with restatements marked as they would be on arrival."""
    first, second = loads(spark, sf_dir)
    return mark_restatements(first).unionByName(mark_restatements(second, first))


# --- prices ----------------------------------------------------------------------------

PRICE_SQL = """
price AS (
  SELECT o_orderpriority AS entity_id, CAST(o_orderdate AS DATE) AS effective_date,
         avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""
SUPPLIER_PRICE_SQL = """
price AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(l_shipdate AS DATE) AS effective_date,
         avg(l_extendedprice / l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""
RETURNS_SQL = """,
rets AS (
  SELECT * FROM (SELECT *, value / lag(value) OVER w - 1 AS ret, row_number() OVER w - 1 AS t
                 FROM price WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date))
  WHERE ret IS NOT NULL)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("entity_id"),
        F.to_date("o_orderdate").alias("effective_date")).agg(F.avg("o_totalprice").alias("value"))


def supplier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("entity_id"),
        F.to_date("l_shipdate").alias("effective_date")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


# --- labels ------------------------------------------------------------------------------

LABEL_DAYS = 30
LABELS_SQL = f"""
labels AS (
  SELECT o_orderpriority AS series_id,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
         CAST(o_orderdate AS DATE) AS t0, CAST(o_orderdate AS DATE) + {LABEL_DAYS} AS t1 FROM orders),
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n,
                 ntile(5) OVER (PARTITION BY series_id ORDER BY idx) - 1 AS fold FROM labels),
bounds AS (SELECT series_id, fold, n, min(t0) AS test_start, max(t1) AS test_end,
                  max(idx) AS last_idx FROM sized GROUP BY ALL),
roles AS (
  SELECT l.series_id, b.fold, l.idx, l.t0, l.t1, b.test_start, b.test_end,
         CASE WHEN l.fold = b.fold THEN 'test'
              WHEN l.t0 <= b.test_end AND l.t1 >= b.test_start THEN 'purged'
              WHEN l.idx > b.last_idx AND l.idx <= b.last_idx + floor(b.n * 0.01) THEN 'embargoed'
              ELSE 'train' END AS role
  FROM sized l JOIN bounds b USING (series_id))"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations whose label resolves ``LABEL_DAYS`` later."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), "o_orderdate", "o_orderkey",
        F.to_date("o_orderdate").alias("t0"),
        F.date_add(F.to_date("o_orderdate"), LABEL_DAYS).alias("t1"))
    return index_labels(rows, ["o_orderdate", "o_orderkey"]).select("series_id", "idx", "t0", "t1")


# --- ledgers -------------------------------------------------------------------------------

TRIALS_SQL = """
trials AS (
  SELECT CAST(event_id AS VARCHAR) AS trial_id, event_type AS dataset_id,
         CAST(user_id AS VARCHAR) AS search_id, ts AS started_at,
         CASE WHEN value >= 5 THEN value / 10000 END AS sharpe FROM events)"""
TRIAL_LOG_SQL = """
trial_log AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS trial_id,
         CASE WHEN event_type IN ('signup', 'view') THEN 'started' ELSE 'outcome' END AS kind,
         event_type AS dataset_id, CAST(user_id AS VARCHAR) AS search_id FROM events)"""
HOLDOUT_SQL = """
periods AS (
  SELECT event_type AS dataset_id, min(CAST(ts AS DATE)) + 20 AS start_date,
         min(CAST(ts AS DATE)) + 25 AS end_date FROM events
  WHERE event_type <> 'signup' GROUP BY 1),
requests AS (
  SELECT event_type AS dataset_id, user_id, min(CAST(ts AS DATE)) AS start_date,
         min(CAST(ts AS DATE)) + CAST(floor(max(value) / 20) AS INTEGER) AS end_date
  FROM events GROUP BY 1, 2)"""
EVALUATIONS_SQL = """
evaluations AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS evaluation_id, o_orderpriority AS dataset_id,
         CAST(o_custkey AS VARCHAR) AS strategy_family,
         o_orderpriority || '/' || CAST(o_custkey AS VARCHAR) AS registration_id,
         o_orderdate AS evaluated_at FROM orders),
registrations AS (
  SELECT DISTINCT o_orderpriority || '/' || CAST(o_custkey AS VARCHAR) AS registration_id
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0)"""
RUNS_SQL = """
runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS strategy, user_id,
         value > 50 AS uses_momentum, value < 20 AS uses_reversal, ts AS started_at,
         CASE WHEN value < 10 THEN 'failed' ELSE 'completed' END AS outcome FROM events)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("trial_id"),
        F.col("event_type").alias("dataset_id"), F.col("user_id").cast("string").alias("search_id"),
        F.col("ts").alias("started_at"),
        F.when(F.col("value") >= 5, F.col("value") / 10000).alias("sharpe"))


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log in which several starts and outcomes can share a trial."""
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", user, F.to_date("ts").cast("string")).alias("trial_id"),
        F.when(F.col("event_type").isin("signup", "view"), "started").otherwise("outcome")
        .alias("kind"), F.col("event_type").alias("dataset_id"), user.alias("search_id"))


def holdout_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.to_date("ts"))
    return (table(spark, sf_dir, "events").where("event_type <> 'signup'")
            .groupBy(F.col("event_type").alias("dataset_id"))
            .agg(F.date_add(first, 20).alias("start_date"),
                 F.date_add(first, 25).alias("end_date")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.to_date("ts"))
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("event_type").alias("dataset_id"), "user_id")
            .agg(first.alias("start_date"),
                 F.date_add(first, F.floor(F.max("value") / 20).cast("int")).alias("end_date")))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("evaluation_id"),
        F.col("o_orderpriority").alias("dataset_id"), family.alias("strategy_family"),
        F.concat_ws("/", "o_orderpriority", family).alias("registration_id"),
        F.col("o_orderdate").alias("evaluated_at"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    solvent = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("strategy_family"))
    return (evaluations(spark, sf_dir).join(solvent, "strategy_family")
            .select("registration_id").distinct())


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("strategy"),
        "user_id", F.col("event_type").alias("dataset_id"),
        F.array_compact(F.array(F.when(value > 50, "momentum"), F.when(value < 20, "reversal"))
                        ).alias("factors"),
        F.col("ts").alias("started_at"),
        F.when(value < 10, "failed").otherwise("completed").alias("outcome"))


# --- instruments, trades, bets, paths -----------------------------------------------------------

INSTRUMENTS_SQL = """
instruments AS (
  SELECT CAST(p_partkey AS VARCHAR) AS symbol, avg(l_extendedprice / l_quantity) AS price,
         sum(l_quantity) / 5 AS adv, 0.01 + any_value(p_size) / 1000.0::DOUBLE AS daily_volatility,
         any_value(p_retailprice) * 1000 AS shares_outstanding, 0.0005::DOUBLE AS spread,
         0.0005::DOUBLE AS commission, max(l_quantity) * 0.8 AS borrow_available,
         0.005::DOUBLE AS borrow_fee_annual
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey),
trades AS (
  SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS symbol,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS shares,
         l_linenumber * 5 AS days_held FROM lineitem)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.sum("l_quantity") / 5).alias("adv"),
        (F.max("l_quantity") * 0.8).alias("borrow_available"))
    parts = table(spark, sf_dir, "part")
    return parts.join(lines, parts.p_partkey == lines.l_partkey).select(
        F.col("p_partkey").cast("string").alias("symbol"), "price", "adv",
        (0.01 + F.col("p_size") / 1000.0).alias("daily_volatility"),
        (F.col("p_retailprice") * 1000).alias("shares_outstanding"),
        F.lit(0.0005).alias("spread"), F.lit(0.0005).alias("commission"), "borrow_available",
        F.lit(0.005).alias("borrow_fee_annual"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").cast("string").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", -quantity).otherwise(quantity).alias("shares"),
        (F.col("l_linenumber") * 5).alias("days_held"))


BETS_SQL = """
bets AS (
  SELECT event_type AS strategy, value > 40 AS win, abs(value - 40) AS amount FROM events)"""


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a bet on its value exceeding 40, paid by the distance."""
    gap = F.col("value") - 40
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("strategy"), (gap > 0).alias("win"),
        F.abs(gap).alias("amount"))


PATHS_SQL = SUPPLIER_PRICE_SQL + """,
paths AS (
  SELECT entity_id AS path_id, row_number() OVER w - 1 AS step,
         100 * value / first_value(value) OVER w AS value
  FROM price WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date))"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("entity_id").orderBy("effective_date")
    return supplier_prices(spark, sf_dir).select(
        F.col("entity_id").alias("path_id"), (F.row_number().over(order) - 1).alias("step"),
        (100 * F.col("value") / F.first("value").over(order)).alias("value"))


PORTFOLIO_SQL = """
monthly AS (
  SELECT c_mktsegment AS portfolio_id, o_orderstatus AS entity_id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS effective_date,
         avg(o_totalprice) AS value
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
asset_rets AS (
  SELECT * FROM (SELECT *, value / lag(value) OVER (PARTITION BY portfolio_id, entity_id
                 ORDER BY effective_date) - 1 AS ret FROM monthly) WHERE ret IS NOT NULL)"""


def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three assets (order states) in each of five portfolios (market segments), monthly."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    monthly = (orders.join(customers, orders.o_custkey == customers.c_custkey)
               .groupBy(F.col("c_mktsegment").alias("portfolio_id"),
                        F.col("o_orderstatus").alias("entity_id"),
                        F.to_date(F.date_trunc("month", "o_orderdate")).alias("effective_date"))
               .agg(F.avg("o_totalprice").alias("value")))
    order = W.partitionBy("portfolio_id", "entity_id").orderBy("effective_date")
    return monthly.withColumn("ret", F.col("value") / F.lag("value").over(order) - 1).where(
        "ret IS NOT NULL")
