"""Bitemporal reads, restatements and panels on the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitemporal, universe, validation
from . import bindings as b
from .registry import query, r6

KNOWN_BY = "1999-06-30"


@query(f"""WITH {b.FIRSTS_SQL}
SELECT entity_id, count(*) AS periods, count(DISTINCT field) AS fields,
       round(sum(value), 2) AS total_value, max(knowledge_date) AS last_learned
FROM firsts WHERE knowledge_date <= DATE '{KNOWN_BY}' GROUP BY 1""")
def first_report_summary(spark, sf_dir):
    """Flagship: what was known by a date, as first reported, per entity."""
    first = bitemporal.first_reports(b.facts(spark, sf_dir), KNOWN_BY)
    return first.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("periods"), F.count_distinct("field").alias("fields"),
        F.round(F.sum("value"), 2).alias("total_value"),
        F.max("knowledge_date").alias("last_learned"))


@query(f"""WITH {b.FACTS_SQL}
SELECT entity_id, field, value, effective_date, knowledge_date FROM facts
WHERE knowledge_date <= DATE '{KNOWN_BY}' ORDER BY effective_date, knowledge_date""")
def as_of_facts(spark, sf_dir):
    known = bitemporal.as_of(b.facts(spark, sf_dir), KNOWN_BY)
    return bitemporal.in_time_order(known).select(
        "entity_id", "field", "value", "effective_date", "knowledge_date")


@query(f"""WITH {b.FIRSTS_SQL}
SELECT entity_id, field, effective_date, value, knowledge_date FROM firsts""")
def first_reports(spark, sf_dir):
    return bitemporal.first_reports(b.facts(spark, sf_dir))


@query(f"""WITH {b.FIRSTS_SQL}
SELECT entity_id, effective_date, value FROM firsts
WHERE field = 'line_1' AND effective_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
ORDER BY effective_date""")
def first_report_series(spark, sf_dir):
    return bitemporal.series(b.facts(spark, sf_dir), "line_1", start="1996-01-01",
                             end="2000-12-31").orderBy("effective_date")


@query(f"""WITH {b.FIRSTS_SQL}, last_report AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field, effective_date
                 ORDER BY knowledge_date DESC, version_number DESC, value DESC) AS rl FROM facts)
  WHERE rl = 1)
SELECT entity_id, field, effective_date, l.value, l.knowledge_date,
       f.value AS as_first_reported, f.value <> l.value AS differs_from_as_reported,
       true AS look_ahead_contaminated
FROM last_report l JOIN firsts f USING (entity_id, field, effective_date)""")
def latest_with_restatements(spark, sf_dir):
    return bitemporal.latest_with_restatements(b.facts(spark, sf_dir), acknowledge=True)


@query(f"""WITH {b.MARKED_SQL}
SELECT entity_id, field, effective_date, version_number, value, knowledge_date, is_restatement
FROM marked""")
def mark_restatements(spark, sf_dir):
    return b.marked_facts(spark, sf_dir).drop("source")


@query(f"""WITH {b.MARKED_SQL}
SELECT entity_id, field, effective_date, baseline, already_stored, count(*) AS n_incoming
FROM marked WHERE version_number = 2 GROUP BY ALL""")
def restatement_index(spark, sf_dir):
    """The join of an incoming load with the first values already stored."""
    stored, batch = b.loads(spark, sf_dir)
    return bitemporal.restatement_baseline(batch, stored)


@query(f"""WITH {b.MARKED_SQL}
SELECT entity_id, field, value, effective_date, knowledge_date, version_number
FROM marked WHERE is_restatement ORDER BY knowledge_date""")
def restatement_log(spark, sf_dir):
    return (bitemporal.restatements(b.marked_facts(spark, sf_dir)).orderBy("knowledge_date")
            .select("entity_id", "field", "value", "effective_date", "knowledge_date",
                    "version_number"))


@query(f"""WITH {b.MARKED_SQL}, per AS (
  SELECT entity_id, max(CAST(is_restatement AS INTEGER)) AS restated FROM marked GROUP BY 1)
SELECT count(*) AS filers, CAST(sum(restated) AS BIGINT) AS restating_filers,
       round(avg(restated), 6) AS restatement_rate FROM per""")
def restatement_rate(spark, sf_dir):
    return bitemporal.restatement_rate(b.marked_facts(spark, sf_dir)).withColumn(
        "restatement_rate", r6("restatement_rate"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, count(*) AS observations,
       min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date,
       round(min(c_acctbal), 2) AS lowest
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0 GROUP BY 1""")
def non_positive_facts(spark, sf_dir):
    """Entities holding a value no return can be formed from."""
    orders, customers = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")
    balances = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.lit("balance").alias("field"),
        F.col("c_acctbal").alias("value"), F.to_date("o_orderdate").alias("effective_date"))
    return bitemporal.non_positive_entities(balances, "balance")


@query(f"""WITH {b.FACT_IN_SQL}
SELECT CASE WHEN knowledge_date < effective_date THEN 'known before its period' END AS reason,
       version_number, count(*) AS facts FROM fact_in GROUP BY 1, 2""")
def fact_validation(spark, sf_dir):
    return validation.fact_reasons(b.fact_input(spark, sf_dir)).groupBy(
        "reason", "version_number").agg(F.count(F.lit(1)).alias("facts"))


@query("""WITH catalog AS (
  SELECT event_type AS dataset_id, avg(value) < 50 AS point_in_time FROM events
  WHERE event_type <> 'error' GROUP BY 1)
SELECT e.dataset_id, CASE WHEN c.dataset_id IS NULL THEN 'not registered'
       ELSE 'not point-in-time: no vintages' END AS reason
FROM (SELECT DISTINCT event_type AS dataset_id FROM events) e
LEFT JOIN catalog c USING (dataset_id)
WHERE c.dataset_id IS NULL OR NOT c.point_in_time""")
def point_in_time_guard(spark, sf_dir):
    """Datasets a backtest must be refused, with the reason."""
    events = b.table(spark, sf_dir, "events").withColumnRenamed("event_type", "dataset_id")
    catalog = (events.where("dataset_id <> 'error'").groupBy("dataset_id")
               .agg((F.avg("value") < 50).alias("point_in_time"))
               .withColumn("pit_note", F.lit("no vintages")))
    return bitemporal.point_in_time_refusals(events.select("dataset_id"), catalog)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_WIDE = ", ".join(f"max(value) FILTER (entity_id = '{p}') AS \"{p}\"" for p in PRIORITIES)
_ROUNDED = ", ".join(f"round(\"{p}\", 4) AS \"{p}\"" for p in PRIORITIES)
_WIDE_SQL = f"""WITH {b.PRICE_SQL},
wide AS (SELECT effective_date, {_WIDE} FROM price GROUP BY 1)
SELECT effective_date, {_ROUNDED} FROM wide"""


@query(_WIDE_SQL)
def cross_section_panel(spark, sf_dir):
    wide = bitemporal.wide_panel(b.prices(spark, sf_dir), PRIORITIES)
    return wide.select("effective_date", *[r6(f"`{p}`", 4).alias(p) for p in PRIORITIES])


@query(_WIDE_SQL + " WHERE " + " AND ".join(f"\"{p}\" IS NOT NULL" for p in PRIORITIES))
def complete_case_panel(spark, sf_dir):
    """Days on which every priority was ordered; none, where the tables are that small."""
    wide = bitemporal.whole_dates(bitemporal.wide_panel(b.prices(spark, sf_dir), PRIORITIES), PRIORITIES)
    return wide.select("effective_date", *[r6(f"`{p}`", 4).alias(p) for p in PRIORITIES])


@query(f"""WITH {b.PRICE_SQL},
n AS (SELECT count(DISTINCT entity_id) AS k FROM price),
full_dates AS (SELECT effective_date FROM price GROUP BY 1 HAVING count(*) = (SELECT k FROM n))
SELECT effective_date, entity_id, round(value, 4) AS value FROM price
WHERE effective_date IN (SELECT effective_date FROM full_dates)""")
def complete_dates(spark, sf_dir):
    return bitemporal.complete_dates(b.prices(spark, sf_dir)).withColumn("value", r6("value", 4))


@query(f"""WITH {b.SUPPLIER_PRICE_SQL},
spans AS (SELECT count(*) AS entities, max(lo) AS common_start, min(hi) AS common_end
  FROM (SELECT entity_id, min(effective_date) AS lo, max(effective_date) AS hi
        FROM price GROUP BY 1)),
dates AS (SELECT effective_date, count(*) AS n FROM price GROUP BY 1)
SELECT entities, common_start, common_end, count(*) AS dates,
       count(*) FILTER (n < entities) AS incomplete_dates,
       round(avg(CASE WHEN n < entities THEN 1.0 ELSE 0.0 END), 6) AS incomplete_share,
       count(*) FILTER (effective_date BETWEEN common_start AND common_end) AS common_dates,
       count(*) FILTER (n < entities AND effective_date BETWEEN common_start AND common_end)
         AS common_incomplete_dates
FROM dates, spans GROUP BY 1, 2, 3""")
def panel_coverage(spark, sf_dir):
    return bitemporal.panel_coverage(b.supplier_prices(spark, sf_dir)).withColumn(
        "incomplete_share", r6("incomplete_share"))


_PAIRS_SQL = f"""{b.FIRSTS_SQL}, lasts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field, effective_date
                 ORDER BY knowledge_date DESC, version_number DESC, value DESC) AS rl FROM facts)
  WHERE rl = 1),
pairs AS (
  SELECT * FROM (SELECT f.entity_id, f.effective_date, f.value AS honest, l.value AS hindsight,
                 row_number() OVER (PARTITION BY f.entity_id ORDER BY f.effective_date DESC) AS r
                 FROM firsts f JOIN lasts l USING (entity_id, field, effective_date)
                 WHERE f.field = 'line_1' AND f.knowledge_date <= DATE '{KNOWN_BY}') WHERE r = 1)"""


@query(f"""WITH {_PAIRS_SQL}
SELECT entity_id, effective_date, honest, hindsight FROM pairs""")
def honest_and_hindsight(spark, sf_dir):
    return bitemporal.honest_and_hindsight(b.facts(spark, sf_dir), "line_1", KNOWN_BY)


@query(f"""WITH {_PAIRS_SQL}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY honest, entity_id) - 1 AS ra,
         row_number() OVER (ORDER BY hindsight, entity_id) - 1 AS rb,
         count(*) OVER () AS n FROM pairs),
bucketed AS (SELECT *, ra * 10 // n AS ba, rb * 10 // n AS bb FROM ranked)
SELECT count(*) AS companies, count(*) FILTER (honest <> hindsight) AS restated,
       round(avg(CAST(honest <> hindsight AS INTEGER)), 6) AS restated_share,
       round(corr(ra, rb), 6) AS spearman, count(*) FILTER (ba <> bb) AS changed_bucket,
       round(avg(CAST(ba <> bb AS INTEGER)), 6) AS changed_bucket_share FROM bucketed""")
def rank_churn(spark, sf_dir):
    churn = universe.rank_churn(b.facts(spark, sf_dir), "line_1", KNOWN_BY)
    return churn.withColumns({c: r6(c) for c in ("restated_share", "spearman",
                                                 "changed_bucket_share")})


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}, latest AS (
  SELECT entity_id, max_by(value, effective_date) AS value FROM price GROUP BY 1)
SELECT entity_id, round(value, 3) AS value,
       row_number() OVER (ORDER BY value, entity_id) - 1 AS value_rank,
       CAST((row_number() OVER (ORDER BY value, entity_id) - 1) * 7 // count(*) OVER () AS INTEGER)
         AS value_bucket
FROM latest""")
def rank_and_bucket(spark, sf_dir):
    latest = b.supplier_prices(spark, sf_dir).groupBy("entity_id").agg(
        F.max_by("value", "effective_date").alias("value"))
    return universe.rank_and_bucket(latest, "value", 7, "value").withColumn("value", r6("value", 3))


@query("""SELECT c_custkey AS cik FROM customer ORDER BY c_custkey LIMIT 500""")
def select_universe(spark, sf_dir):
    """The first N companies by registration number (the limit is the operator)."""
    companies = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"))
    return universe.select_universe(companies, 500)


@query(f"""WITH {b.FACTS_SQL},
per AS (SELECT entity_id, count(*) AS n FROM facts GROUP BY 1)
SELECT count(*) AS considered, count(n) AS loaded, count(*) - count(n) AS skipped_no_data,
       CAST(0 AS BIGINT) AS skipped_error, CAST(sum(n) AS BIGINT) AS facts,
       round(1 - count(n) / count(*)::DOUBLE, 6) AS skip_rate
FROM (SELECT CAST(c_custkey AS VARCHAR) AS entity_id FROM customer) LEFT JOIN per USING (entity_id)
""")
def universe_build_report(spark, sf_dir):
    candidates = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"))
    return universe.build_report(candidates, b.facts(spark, sf_dir)).withColumn("skip_rate", r6("skip_rate"))
