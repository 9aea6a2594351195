"""Sources, versions, composed loads and streams on files Spark derives from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bitemporal, factors, fingerprint, folds, ledger, sweep, universe
from ..schemas import DATASETS
from ..session import scratch_path
from ..sources import archive, filings, observations, versions
from ..streaming import bars, ingest
from . import bindings as b
from . import research
from .registry import query, r6
from .search_queries import _sweep_sql, windows_count, windows_table

_PRICE4 = f"""{b.PRICE_SQL}, cents AS (
  SELECT entity_id, effective_date, CAST(round(value, 0) AS BIGINT) AS cents FROM price)"""


def _write_observations(spark, sf_dir) -> str:
    """One folder of CSV files per entity; thin days are written as missing."""
    path = scratch_path(spark, "observations")
    panel = b.prices(spark, sf_dir)
    raw = F.when(F.col("value") < 100_000, F.lit(".")).otherwise(
        F.round("value", 0).cast("long").cast("string"))
    (panel.select("entity_id", F.col("effective_date").cast("string").alias("observation_date"),
                  raw.alias("series"))
     .write.partitionBy("entity_id").option("header", "true").csv(path))
    return path


@query(f"""WITH {b.PRICE_SQL}
SELECT entity_id, 'close' AS field, CAST(CAST(round(value, 0) AS BIGINT) AS DOUBLE) AS value,
       effective_date, effective_date AS knowledge_date FROM price WHERE value >= 100000""")
def observation_csv_facts(spark, sf_dir):
    """A folder of observation CSVs as facts; missing marks are dropped."""
    path = _write_observations(spark, sf_dir)
    facts, _ = observations.observation_facts(spark, path, entity_pattern=r"entity_id=([^/]+)/")
    return facts.select("entity_id", "field", "value", "effective_date", "knowledge_date")


_VINTAGES = ["1997-06-30", "1999-06-30", "2001-06-30"]


def _write_vintages(spark, sf_dir) -> str:
    """What each vintage date knew of every period, plus rows dated after it."""
    path = scratch_path(spark, "vintages")
    cuts = F.explode(F.array(*[F.lit(v).cast("date") for v in _VINTAGES])).alias("vintage")
    known = (b.facts(spark, sf_dir).select("*", cuts)
             .where(F.col("knowledge_date") <= F.date_add("vintage", 20))
             .groupBy("field", "effective_date", "vintage").agg(F.max("value").alias("value")))
    (known.select("field", F.date_format("vintage", "yyyyMMdd").alias("vintage"),
                  F.col("effective_date").cast("string").alias("observation_date"),
                  F.col("value").cast("string").alias("series"))
     .write.partitionBy("field", "vintage").option("header", "true").csv(path))
    return path


def _vintage_facts(spark, sf_dir):
    return observations.vintage_facts(
        spark, _write_vintages(spark, sf_dir), entity_pattern=r"field=([^/]+)/",
        vintage_pattern=r"vintage=(\d{8})/")


_VINTAGE_SQL = f"""{b.FACTS_SQL}, v(vintage) AS (
  VALUES {', '.join(f"(DATE '{v}')" for v in _VINTAGES)}),
vint AS (SELECT field AS entity_id, effective_date, vintage AS knowledge_date, max(value) AS value FROM facts, v
  WHERE knowledge_date <= vintage + 20 GROUP BY ALL),
kept AS (SELECT * FROM vint WHERE effective_date <= knowledge_date),
vfirst AS (SELECT entity_id, effective_date, first(value ORDER BY knowledge_date) AS v0 FROM kept
  GROUP BY 1, 2)"""


@query(f"""WITH {_VINTAGE_SQL}
SELECT entity_id, effective_date, knowledge_date, value,
       'ALFRED@' || CAST(knowledge_date AS VARCHAR) AS source FROM kept""")
def vintage_csv_facts(spark, sf_dir):
    """Many vintages of a revised series in one job; rows after the vintage are dropped."""
    return _vintage_facts(spark, sf_dir)[0].select("entity_id", "effective_date", "knowledge_date",
                                                   "value", "source")


# --- filings -------------------------------------------------------------------------------

def _documents(spark, sf_dir):
    """Each order as one filing document of its customer: its lines are the records."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date(
        "o_orderdate").alias("end"))
    lines = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("val"),
        F.to_date("l_shipdate").cast("string").alias("filed"),
        F.when(F.col("l_returnflag") == "N", "8-K").otherwise("10-K").alias("form"))
    record = F.struct(F.col("end").cast("string").alias("end"), "val", "form", "filed",
                      F.col("l_orderkey").cast("string").alias("accn"))
    line = F.col("l_linenumber")
    # An order has a handful of lines, so the lists below stay small.
    tags = {"StockholdersEquity": line == 1, "Assets": line == 2, "Liabilities": line > 2}
    units = lambda records: F.struct(
        F.create_map(F.lit("USD"), records).alias("units"))
    concepts = F.map_filter(
        F.create_map(*[x for tag in tags for x in (F.lit(tag), units(F.col(tag)))]),
        lambda _, concept: F.size(concept["units"]["USD"]) > 0)
    return (orders.join(lines, orders.o_orderkey == lines.l_orderkey)
            .groupBy("o_orderkey", "o_custkey")
            .agg(*[F.collect_list(F.when(test, record)).alias(tag) for tag, test in tags.items()])
            .select(filings.entity_id(F.col("o_custkey")).alias("entity_id"),
                    F.col("o_custkey").alias("cik"),
                    F.to_json(F.struct(
                        F.col("o_custkey").cast("string").alias("cik"),
                        F.create_map(F.lit("us-gaap"), concepts).alias("facts")))
                    .alias("payload")))


_FILING_SQL = """filing AS (
  SELECT DISTINCT 'CIK' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS entity_id,
    CASE l_linenumber WHEN 1 THEN 'book_equity' ELSE 'assets' END AS field,
    l_extendedprice AS value, CAST(o_orderdate AS DATE) AS effective_date,
    CAST(l_shipdate AS DATE) AS knowledge_date
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_linenumber IN (1, 2) AND l_returnflag <> 'N')"""


@query(f"WITH {_FILING_SQL} SELECT * FROM filing")
def filing_facts(spark, sf_dir):
    """Facts from company JSON documents: tags picked, forms filtered, repeats collapsed."""
    return filings.filing_facts(_documents(spark, sf_dir), forms=("10-K",)).drop("source")


@query("""SELECT DISTINCT 'CIK' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS entity_id,
    CASE l_linenumber WHEN 1 THEN 'StockholdersEquity' WHEN 2 THEN 'Assets' ELSE 'Liabilities' END
      AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def available_tags(spark, sf_dir):
    return filings.available_tags(_documents(spark, sf_dir))


@query("""SELECT 'CIK' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS entity_id, c_name AS name,
    c_acctbal > 0 AS still_listed, CAST(max(o_orderdate) AS DATE) AS last_filing,
    c_mktsegment AS sic_description
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def listing_status(spark, sf_dir):
    """Listed or not, and the last filing, from submission documents."""
    ends = b.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_compact(F.array(F.min("o_orderdate"), F.max("o_orderdate"))).alias("dates"))
    customers = b.table(spark, sf_dir, "customer")
    listed = lambda x: F.when(F.col("c_acctbal") > 0, F.array(F.col(x))).otherwise(
        F.array().cast("array<string>"))
    dates = F.transform(F.coalesce("dates", F.array().cast("array<timestamp_ntz>")),
                        lambda d: F.to_date(d).cast("string"))
    filed = F.struct(F.struct(dates.alias("filingDate")).alias("recent"))
    documents = customers.join(ends, customers.c_custkey == ends.o_custkey, "left").select(
        filings.entity_id(F.col("c_custkey")).alias("entity_id"),
        F.to_json(F.struct(F.col("c_custkey").cast("string").alias("cik"),
                           F.col("c_name").alias("name"), listed("c_name").alias("tickers"),
                           listed("c_mktsegment").alias("exchanges"),
                           F.col("c_mktsegment").alias("sicDescription"),
                           filed.alias("filings"))).alias("payload"))
    return filings.listing_status(documents)


@query("""SELECT url AS name, sha256(html) AS sha256, octet_length(encode(html)) AS bytes,
    url || '@' || substr(sha256(html), 1, 16) AS version_id FROM pages""")
def archive_manifest(spark, sf_dir):
    """Digest, size and version id of every document in an archive."""
    pages = b.table(spark, sf_dir, "pages")
    return archive.manifest(pages.select(F.col("url").alias("name"), F.col("html").alias("content")))


@query("""SELECT url AS name, CASE WHEN html LIKE '%Nicht%' THEN 'changed' ELSE 'same' END AS state
FROM pages""")
def archive_verification(spark, sf_dir):
    """The archive against a manifest recorded before some documents changed."""
    pages = b.table(spark, sf_dir, "pages").select(F.col("url").alias("name"),
                                                   F.col("html").alias("content"))
    edited = pages.withColumn("content", F.regexp_replace("content", "Nicht", "nicht"))
    return archive.verify(archive.manifest(pages), archive.manifest(edited))


# --- versions ------------------------------------------------------------------------------------

def _registered(spark):
    return spark.createDataFrame([("orders", "order lines", True, None)], DATASETS)


def _two_loads(spark, sf_dir) -> tuple[str, list[str]]:
    """Both loads appended, and the first one again."""
    root, known = scratch_path(spark, "store"), _registered(spark)
    first, second = b.loads(spark, sf_dir)
    ids = [versions.append_facts(spark, root, "orders", load.drop("version_number"), known)
           for load in (first, second, first)]
    return root, ids


@query(f"""WITH {b.FACTS_SQL}
SELECT 'orders@v' || CAST(version_number AS VARCHAR) AS version_id,
       CAST(version_number AS INTEGER) AS version_number, count(*) AS row_count,
       max(knowledge_date) AS knowledge_date FROM facts GROUP BY version_number""")
def append_versions(spark, sf_dir):
    """Two loads become two immutable versions; repeating one adds none."""
    root, _ = _two_loads(spark, sf_dir)
    return versions.versions(spark, root, "orders").select(
        "version_id", "version_number", "row_count", "knowledge_date")


@query(f"""WITH {b.FACTS_SQL}, n AS (SELECT version_number AS v, count(*) AS row_count FROM facts GROUP BY 1)
SELECT load, 'orders@v' || CAST(v AS VARCHAR) AS version_id, row_count
FROM (VALUES ('first', 1), ('second', 2), ('first again', 1)) l(load, v) JOIN n USING (v)""")
def idempotent_load(spark, sf_dir):
    """A load with known content returns the version that already holds it."""
    root, ids = _two_loads(spark, sf_dir)
    returned = spark.createDataFrame(list(zip(("first", "second", "first again"), ids)),
                                     "load string, version_id string")
    stored = versions.versions(spark, root, "orders").select("version_id", "row_count")
    return returned.join(stored, "version_id").select("load", "version_id", "row_count")


@query(f"""WITH {b.FACTS_SQL}
SELECT 'orders' AS dataset_id, 'orders@v' || CAST(max(version_number) AS VARCHAR) AS version_id,
       CAST(max(version_number) AS INTEGER) AS version_number,
       count(*) FILTER (version_number = 2) AS row_count FROM facts""")
def current_versions(spark, sf_dir):
    root, _ = _two_loads(spark, sf_dir)
    catalogue = versions.versions(spark, root)
    return versions.current_versions(catalogue).join(
        catalogue.select("version_id", "row_count"), "version_id")


@query(f"""WITH {b.MARKED_SQL}
SELECT CAST(version_number AS INTEGER) AS version_number, entity_id, field, effective_date,
       knowledge_date, value, is_restatement FROM marked""")
def stored_facts(spark, sf_dir):
    """Facts read back from the store, marked on arrival."""
    root, _ = _two_loads(spark, sf_dir)
    return versions.read_facts(spark, root, "orders").select(
        "version_number", "entity_id", "field", "effective_date", "knowledge_date", "value",
        "is_restatement")


def _digest_sql(columns: list[str], where: str = "") -> str:
    """The multiset digest in SQL; a bucket's rows with ``where``."""
    text = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')"
                       for c in columns)
    half = lambda at: (f"sum(CAST(('0x' || substr(md5({text}), {at}, 16)) AS UBIGINT)"  # noqa: E731
                       "::HUGEINT)")
    return f"md5(count(*) || '|' || {half(1)} || '|' || {half(17)})"


_CONTENT = sorted(versions.CONTENT)
_BUCKET_SQL = ("CAST(CAST('0x' || substr(md5(length(entity_id) || ':' || entity_id), 1, 8) AS UBIGINT)"
               " % 64 AS INTEGER)")


@query(f"""WITH {b.FACTS_SQL}
SELECT CAST(version_number AS INTEGER) AS version_number, count(*) AS row_count,
       {_digest_sql(_CONTENT)} AS content_hash FROM facts GROUP BY version_number""")
def content_hash(spark, sf_dir):
    """Order-insensitive fingerprint of each load, as any engine computes it."""
    facts = b.facts(spark, sf_dir).select("version_number", *versions.CONTENT)
    return fingerprint.fingerprint(facts, ["version_number"])


@query(f"""WITH {b.FACTS_SQL}
SELECT CAST(version_number AS INTEGER) AS version_number, count(*) AS row_count,
       version_number = 1 AS reproduced FROM facts GROUP BY version_number""")
def replay_check(spark, sf_dir):
    """A recorded result against a recomputation in which one group's values changed."""
    facts = b.facts(spark, sf_dir).select("version_number", *versions.CONTENT)
    again = facts.repartition("value").withColumn("value", F.when(
        F.col("version_number") == 2, F.col("value") + 1).otherwise(F.col("value")))
    out = fingerprint.replay_check(fingerprint.fingerprint(facts, ["version_number"]),
                                   fingerprint.fingerprint(again, ["version_number"]),
                                   ["version_number"])
    return out.select("version_number", "row_count", "reproduced")


@query(f"""WITH {b.FACTS_SQL}, changed AS (
  SELECT *, {_BUCKET_SQL} AS bucket FROM facts)
SELECT CAST(version_number AS INTEGER) AS version_number, bucket, count(*) AS recorded_rows,
       count(*) FILTER (entity_id <> '1') AS recomputed_rows FROM changed
GROUP BY 1, 2 HAVING count(*) FILTER (value > 104000 OR entity_id = '1') > 0""")
def differing_buckets(spark, sf_dir):
    """Where a recomputation with changed and lost facts differs from the record."""
    facts = b.facts(spark, sf_dir).select("version_number", *versions.CONTENT)
    again = facts.where("entity_id <> '1'").withColumn("value", F.when(
        F.col("value") > 104000, F.col("value") + 1).otherwise(F.col("value")))
    sides = [fingerprint.bucket_digests(x, ["entity_id"], 64, ["version_number"])
             for x in (facts, again)]
    return fingerprint.differing_buckets(*sides, ["version_number"])


# --- composed jobs ------------------------------------------------------------------------------------

_UNIVERSE_SQL = f"""{_FILING_SQL},
chosen AS (SELECT entity_id FROM (SELECT DISTINCT 'CIK' || lpad(CAST(o_custkey AS VARCHAR), 10, '0')
           AS entity_id FROM orders)),
uf AS (SELECT f.* FROM filing f JOIN chosen USING (entity_id) WHERE knowledge_date >= effective_date),
ends AS (SELECT entity_id, effective_date, first(value ORDER BY knowledge_date, value) AS honest,
         min(knowledge_date) AS k0, last(value ORDER BY knowledge_date, value) AS hindsight
         FROM uf WHERE field = 'book_equity' GROUP BY 1, 2),
newest AS (SELECT entity_id, max_by(honest, effective_date) AS honest,
           max_by(hindsight, effective_date) AS hindsight FROM ends
           WHERE k0 <= DATE '1999-06-30' GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY honest, entity_id) - 1 AS ra,
           row_number() OVER (ORDER BY hindsight, entity_id) - 1 AS rb, count(*) OVER () AS n
           FROM newest)"""


@query(f"""WITH {_UNIVERSE_SQL}
SELECT (SELECT count(*) FROM chosen) AS considered,
       (SELECT count(DISTINCT entity_id) FROM uf) AS loaded, (SELECT count(*) FROM uf) AS facts,
       count(*) AS companies, count(*) FILTER (honest <> hindsight) AS restated,
       round(corr(ra, rb), 6) AS spearman,
       count(*) FILTER (ra * 100 // n <> rb * 100 // n) AS changed_bucket FROM ranked
HAVING count(*) >= 100""")
def universe_to_churn(spark, sf_dir):
    """Documents to rank churn: parse, validate, load once, rank twice; all companies."""
    from ..operators.validation import split_facts
    documents = _documents(spark, sf_dir)
    facts, _ = split_facts(filings.filing_facts(documents, forms=("10-K",)))
    root = scratch_path(spark, "universe")
    versions.append_facts(spark, root, "orders", facts, _registered(spark))
    stored = versions.read_facts(spark, root, "orders")
    # A company whose orders have no lines files nothing, but is considered.
    candidates = b.table(spark, sf_dir, "orders").select(
        filings.entity_id(F.col("o_custkey")).alias("entity_id")).distinct()
    report = universe.build_report(candidates, stored).select("considered", "loaded", "facts")
    churn = universe.rank_churn(stored, "book_equity", "1999-06-30", 100).select(
        "companies", "restated", r6("spearman").alias("spearman"), "changed_bucket")
    from ..operators.ordering import one_row
    return churn.select(one_row(report).alias("r"), "*").select("r.*", *churn.columns)


@query(f"""WITH {_VINTAGE_SQL}
SELECT entity_id, effective_date, v0 AS first_reported, last(value ORDER BY knowledge_date) AS latest,
       count(*) FILTER (value <> v0) AS restatements
FROM kept JOIN vfirst USING (entity_id, effective_date) GROUP BY ALL""")
def vintage_load(spark, sf_dir):
    """Vintage files to first and restated values, through one versioned load."""
    facts, _ = _vintage_facts(spark, sf_dir)
    root = scratch_path(spark, "macro")
    versions.append_facts(spark, root, "orders", facts, _registered(spark))
    stored = versions.read_facts(spark, root, "orders")
    ends = bitemporal.latest_with_restatements(stored, acknowledge=True).select(
        "entity_id", "effective_date", F.col("as_first_reported").alias("first_reported"),
        F.col("value").alias("latest"))
    revised = stored.groupBy("entity_id", "effective_date").agg(
        F.sum(F.col("is_restatement").cast("long")).alias("restatements"))
    return ends.join(revised, ["entity_id", "effective_date"])


_GATE = 6, 20


@query(f"""WITH {b.PRICE_SQL}, kept AS (SELECT * FROM price WHERE effective_date <= DATE '2000-12-31'),
rets AS (SELECT * FROM (SELECT entity_id, effective_date, value / lag(value) OVER (
   PARTITION BY entity_id ORDER BY effective_date) - 1 AS ret FROM kept) WHERE ret IS NOT NULL),
{_sweep_sql('rets', '', *_GATE)}
SELECT entity_id, fast, slow, round(observed_sharpe, 6) AS best_sharpe,
       round(var_trials, 9) AS var_trials, (SELECT count(*) FROM rets r WHERE r.entity_id = best.entity_id)
         AS sample_length, CAST({windows_count(*_GATE)} AS BIGINT) AS n_trials,
       CAST({windows_count(*_GATE)} AS BIGINT) AS trials_with_outcome, 'prices@v1' AS dataset_version,
       true AS reproduced, true AS holdout_refused FROM best""")
def gated_search(spark, sf_dir):
    """Load prices, refuse a read into the holdout, run a counted search, replay it."""
    from ..errors import HoldoutViolation
    facts, _ = observations.observation_facts(
        spark, _write_full_prices(spark, sf_dir), entity_pattern=r"entity_id=([^/]+)/")
    root, log, known = (scratch_path(spark, "prices"), scratch_path(spark, "ledger"),
                        spark.createDataFrame([("prices", "daily", True, None)], DATASETS))
    versions.append_facts(spark, root, "prices", facts, known)
    held = spark.sql("SELECT 'prices' AS dataset_id, DATE '2001-01-01' AS start_date, "
                     "DATE '2001-12-31' AS end_date")
    try:
        research.gated_search(spark, root, "prices", "close", known, held, log, windows_table(spark, *_GATE))
        refused = False
    except HoldoutViolation:
        refused = True
    found = research.gated_search(spark, root, "prices", "close", known, held, log, windows_table(spark, *_GATE),
                                  end="2000-12-31", search_id="in-sample")
    replay = research.replay_search(spark, root, log, found.first().run_id,
                                    scratch_path(spark, "replay"))
    from ..operators.ordering import one_row
    again = one_row(replay.select("reproduced"))
    return found.select("entity_id", "fast", "slow", r6("best_sharpe").alias("best_sharpe"),
                        r6("var_trials", 9).alias("var_trials"), "sample_length", "n_trials",
                        "trials_with_outcome",
                        "dataset_version", again.getField("reproduced").alias("reproduced"),
                        F.lit(refused).alias("holdout_refused"))


@query("""SELECT 'completed' AS outcome, 'in-sample' AS search_id, false AS has_error, true AS ended
UNION ALL SELECT 'failed', 'crossed windows', true, true""")
def failed_runs(spark, sf_dir):
    """The log that the gate writes, searched: one run that ended well and one that failed."""
    from ..errors import ResearchError
    from ..operators import ledger
    facts, _ = observations.observation_facts(
        spark, _write_full_prices(spark, sf_dir), entity_pattern=r"entity_id=([^/]+)/")
    root, log, known = (scratch_path(spark, "prices"), scratch_path(spark, "ledger"),
                        spark.createDataFrame([("prices", "daily", True, None)], DATASETS))
    versions.append_facts(spark, root, "prices", facts, known)
    held = spark.createDataFrame([], "dataset_id string, start_date date, end_date date")
    for search, params in (("in-sample", windows_table(spark, *_GATE)), ("crossed windows", [{"fast": 9, "slow": 3}])):
        try:
            research.gated_search(spark, root, "prices", "close", known, held, log, params,
                                  search_id=search)
        except ResearchError:
            continue  # the log has it
    runs = ledger.search_runs(research.run_records(spark, log), "crossover", "close")
    return runs.select("outcome", "search_id", F.col("error").isNotNull().alias("has_error"),
                       (F.col("ended_at") >= F.col("started_at")).alias("ended"))


def _write_full_prices(spark, sf_dir) -> str:
    path = scratch_path(spark, "closes")
    (b.prices(spark, sf_dir).select(
        "entity_id", F.col("effective_date").cast("string").alias("observation_date"),
        F.col("value").cast("string").alias("series"))
     .write.partitionBy("entity_id").option("header", "true").csv(path))
    return path


# --- streams ------------------------------------------------------------------------------------------------

def _bar_files(spark, sf_dir) -> str:
    path = scratch_path(spark, "bars")
    (b.supplier_prices(spark, sf_dir).select(
        "entity_id", F.col("effective_date").cast("timestamp").alias("ts"),
        F.col("value").alias("close")).write.parquet(path))
    return path


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}, s AS (
  SELECT *, lag(value, 5) OVER w / lag(value, 60) OVER w - 1 AS signal FROM price
  WINDOW w AS (PARTITION BY entity_id ORDER BY effective_date)),
p AS (SELECT *, CASE WHEN signal > 0 THEN 1 ELSE 0 END AS position FROM s)
SELECT entity_id, effective_date, round(signal, 6) AS signal, position,
       position <> coalesce(lag(position) OVER (PARTITION BY entity_id ORDER BY effective_date), 0)
         AS changed FROM p""")
def stream_momentum(spark, sf_dir):
    """Bars streamed through bounded state; equal to the batch factor."""
    path = _bar_files(spark, sf_dir)
    stream = spark.readStream.schema("entity_id string, ts timestamp, close double").parquet(path)
    out = scratch_path(spark, "signals")
    bars.run_to_files(bars.stream_momentum(stream), out, scratch_path(spark, "state"))
    done, _ = bars.split_late(spark.read.schema(bars.SIGNAL_OUT).parquet(out))
    return done.select("entity_id", F.to_date("ts").alias("effective_date"),
                       r6("signal").alias("signal"), "position", "changed")


@query(f"""WITH {b.SUPPLIER_PRICE_SQL}, n AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY effective_date) AS delivered FROM price)
SELECT entity_id, effective_date, delivered, value > 1000 AS future_visible,
       CAST(floor(value) AS BIGINT) > delivered AS extra_visible FROM n""")
def stream_lookahead_audit(spark, sf_dir):
    """Bars that claim to see more rows, or later ones, than were delivered."""
    path = scratch_path(spark, "audit")
    (b.supplier_prices(spark, sf_dir).select(
        "entity_id", F.col("effective_date").cast("timestamp").alias("ts"),
        F.floor("value").alias("visible"),
        F.date_add("effective_date", F.when(F.col("value") > 1000, 1).otherwise(0))
        .cast("timestamp").alias("newest_visible")).write.parquet(path))
    stream = spark.readStream.schema(
        "entity_id string, ts timestamp, visible long, newest_visible timestamp").parquet(path)
    out = scratch_path(spark, "audited")
    bars.run_to_files(bars.stream_lookahead_audit(stream), out, scratch_path(spark, "state"))
    return spark.read.schema(bars.AUDIT_OUT).parquet(out).select(
        "entity_id", F.to_date("ts").alias("effective_date"), "delivered", "future_visible",
        "extra_visible")


@query(f"""WITH {b.FACT_IN_SQL}, good AS (SELECT * FROM fact_in WHERE knowledge_date >= effective_date),
f AS (SELECT entity_id, field, effective_date, first(value ORDER BY knowledge_date, value) AS v0
      FROM good GROUP BY ALL)
SELECT 'orders@v1' AS version_id, count(*) AS facts, count(*) FILTER (value <> v0) AS restatements,
       (SELECT count(*) FROM fact_in WHERE knowledge_date < effective_date) AS rejected
FROM good JOIN f USING (entity_id, field, effective_date)""")
def stream_fact_ingest(spark, sf_dir):
    """Fact files ingested as a stream: marked, versioned, invalid rows set aside."""
    path, root, bad = (scratch_path(spark, n) for n in ("arrivals", "stream", "rejected"))
    b.fact_input(spark, sf_dir).drop("version_number").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    ingest.stream_fact_ingest(stream, root, "orders", _registered(spark),
                              scratch_path(spark, "offsets"), bad).awaitTermination()
    stored = versions.fact_ids(versions.read_facts(spark, root, "orders"))
    from ..operators.ordering import one_row
    rejected = one_row(spark.read.parquet(bad).agg(F.count(F.lit(1)).alias("n")))
    return stored.groupBy(F.element_at(F.split("fact_id", "#"), 1).alias("version_id")).agg(
        F.count(F.lit(1)).alias("facts"),
        F.sum(F.col("is_restatement").cast("long")).alias("restatements")).withColumn(
        "rejected", rejected.getField("n"))
