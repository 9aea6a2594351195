"""Files to facts, archives to manifests, loads to versions."""
import json
import shutil

import pytest
from pyspark.sql import functions as F

from factmark.errors import PointInTimeError, ResearchError
from factmark.operators import bitemporal
from factmark.schemas import DATASETS, FACT_IN
from factmark.sources import archive, filings, observations, versions

FEBRUARY = ("observation_date,GDPC1_20240215\n2023-07-01,22490.692\n2023-10-01,22672.859\n"
            "2024-07-01,1.0\n")
JUNE = ("observation_date,GDPC1_20240615\n2023-07-01,22490.692\n2023-10-01,22679.255\n"
        "2024-01-01,22749.846\n")


@pytest.fixture()
def folder(tmp_path):
    def write(**files):
        root = tmp_path / "in"
        root.mkdir(exist_ok=True)
        for name, text in files.items():
            (root / name.replace("__", ".")).write_text(text)
        return str(root)
    return write


def test_closes_are_known_at_the_close_and_holidays_dropped(spark, folder):
    path = folder(SP500__csv="observation_date,SP500\n2016-08-29,2180.38\n2016-08-30,.\n"
                             "2016-08-31,\n2016-09-01,2170.86\n",
                  DJIA__csv="OBSERVATION_DATE,DJIA\n2016-08-29,18502.99\n")
    good, bad = observations.observation_facts(spark, path)
    rows = {(r.entity_id, str(r.effective_date), r.value) for r in good.collect()}
    assert rows == {("SP500", "2016-08-29", 2180.38), ("SP500", "2016-09-01", 2170.86),
                    ("DJIA", "2016-08-29", 18502.99)}
    assert good.where("effective_date <> knowledge_date").count() == 0 == bad.count()
    assert good.schema.fieldNames() == FACT_IN.fieldNames()
    assert observations.header_problems(spark, path).count() == 0


def test_bad_numbers_and_headers_are_reported(spark, folder):
    path = folder(A__csv="observation_date,A\n2020-01-01,abc\n2020-01-02,1\n",
                  B__csv="date,B\n2020-01-01,2\n", C__csv="observation_date,C\n")
    good, bad = observations.observation_facts(spark, path)
    # B's header line is not one, so it is reported like any unreadable line.
    assert {(r.observed, r.raw) for r in bad.collect()} == {("2020-01-01", "abc"), ("date", "B")}
    problems = {r.path.rsplit("/", 1)[1]: r.reason
                for r in observations.header_problems(spark, path).collect()}
    assert problems == {"B.csv": "unexpected CSV header", "C.csv": "header and no observations"}


def test_vintages_cannot_hold_later_observations(spark, folder):
    path = folder(GDPC1_20240215__csv=FEBRUARY, GDPC1_20240615__csv=JUNE)
    good, bad = observations.vintage_facts(spark, path)
    rows = {(str(r.effective_date), str(r.knowledge_date), r.value, r.source)
            for r in good.collect()}
    assert bad.count() == 0 and len(rows) == 5
    assert ("2023-10-01", "2024-02-15", 22672.859, "ALFRED@2024-02-15") in rows
    assert {r.entity_id for r in good.collect()} == {"GDPC1"}
    revised = bitemporal.mark_restatements(good.drop("is_restatement")).where("is_restatement")
    assert [r.value for r in revised.collect()] == [22679.255]


def _record(end, val, filed, form="10-K", accn="a"):
    return {"end": end, "val": val, "form": form, "filed": filed, "accn": accn}


CONCEPT = {"cik": 320193, "taxonomy": "us-gaap", "tag": "StockholdersEquity", "units": {"USD": [
    _record("2009-09-26", 27832000000, "2009-10-27"),
    _record("2009-09-26", 31640000000, "2010-10-27", accn="b"),
    _record("2009-09-26", 31640000000, "2010-10-27", accn="c"),
    _record("2010-09-25", 47791000000, "2010-10-27"),
    _record("2010-09-25", 47791000000, "2010-10-18", form="8-K"),
    _record("2011-09-24", None, "2011-10-26"), _record(None, 1, "2011-10-26")]}}
COMPANY = {"cik": 320193, "entityName": "Apple Inc.", "facts": {
    "us-gaap": {"StockholdersEquity": CONCEPT["units"] and {"units": CONCEPT["units"]},
                "Assets": {"units": {"USD": [_record("2009-09-26", 47501000000, "2009-10-27")]}}},
    "dei": {"SharesOutstanding": {"units": {"shares": [_record("2009-09-26", 9e8, "2009-10-27")]}}}}}


def documents(spark, *payloads):
    rows = [(f"CIK{i:010d}", p if isinstance(p, str) else json.dumps(p))
            for i, p in enumerate(payloads, 1)]
    return spark.createDataFrame(rows, "entity_id string, payload string")


@pytest.mark.parametrize("payload", [CONCEPT, COMPANY])
def test_both_document_shapes_give_the_same_facts(spark, payload):
    facts = filings.filing_facts(documents(spark, payload), forms=("10-K",), tags=[
        ("book_equity", "StockholdersEquity", "us-gaap", "USD")])
    rows = sorted((str(r.effective_date), str(r.knowledge_date), r.value, r.source)
                  for r in facts.collect())
    assert rows == [("2009-09-26", "2009-10-27", 27832e6, "EDGAR/10-K/a"),
                    ("2009-09-26", "2010-10-27", 31640e6, "EDGAR/10-K/b"),
                    ("2010-09-25", "2010-10-27", 47791e6, "EDGAR/10-K/a")]


def test_tags_outside_the_default_taxonomy_are_found(spark):
    tags = [("shares", "SharesOutstanding", "us-gaap", "shares"),
            ("assets", "Assets", "us-gaap", "EUR"), ("none", "Missing", "us-gaap", "USD")]
    rows = filings.filing_facts(documents(spark, COMPANY), tags).collect()
    assert [(r.field, r.value) for r in rows] == [("shares", 9e8)]
    found = filings.available_tags(documents(spark, COMPANY))
    assert sorted(r.tag for r in found.collect()) == ["Assets", "StockholdersEquity"]


def test_all_forms_and_malformed_documents(spark):
    every = filings.filing_facts(documents(spark, CONCEPT), forms=(), tags=[
        ("e", "StockholdersEquity", "us-gaap", "USD")])
    assert every.count() == 4
    bad = filings.malformed(documents(spark, CONCEPT, "{not json", {"cik": 1}))
    assert sorted(r.entity_id for r in bad.collect()) == ["CIK0000000002", "CIK0000000003"]


def test_listing_status(spark):
    def submission(tickers, exchanges, dates):
        return {"cik": "1", "name": "X", "tickers": tickers, "exchanges": exchanges,
                "sicDescription": "s", "filings": {"recent": {"filingDate": dates}}}
    rows = filings.listing_status(documents(
        spark, submission(["AAPL"], ["Nasdaq"], ["2026-08-27", "2026-05-01"]),
        submission([], [], ["2023-09-30", "2023-12-04"]), submission(["A"], [], []))
    ).orderBy("entity_id").collect()
    assert [r.still_listed for r in rows] == [True, False, False]
    assert [str(r.last_filing) for r in rows] == ["2026-08-27", "2023-12-04", "None"]


def test_company_files_are_read_and_others_ignored(spark, folder):
    path = folder(CIK0000000100__json=json.dumps(COMPANY), notacompany__txt="x")
    rows = filings.read_documents(spark, path).collect()
    assert [(r.entity_id, r.cik) for r in rows] == [("CIK0000000100", 100)]


def test_archive_manifest_on_files(spark, folder):
    import hashlib
    path = folder(a__json="alpha", b__json="beta")
    recorded = archive.manifest(archive.file_contents(spark, path)).collect()
    first = next(r for r in recorded if r.name == "a.json")
    assert first.sha256 == hashlib.sha256(b"alpha").hexdigest() and first.bytes == 5
    assert first.version_id == f"a.json@{first.sha256[:16]}"
    kept = spark.createDataFrame([(r.name, r.sha256) for r in recorded] + [("gone", "0")],
                                 "name string, sha256 string")
    folder(b__json="BETA", c__json="gamma")
    now = archive.manifest(archive.file_contents(spark, path))
    assert {r.name: r.state for r in archive.verify(now, kept).collect()} == {
        "a.json": "same", "b.json": "changed", "c.json": "new", "gone": "missing"}


def test_documents_of_one_name_are_each_verified_once(spark, monkeypatch):
    monkeypatch.setattr(archive, "STEP", 2)
    sides = [spark.createDataFrame(rows, "name string, sha256 string") for rows in (
        [("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), (None, "1"), ("c", None), ("d", "1")] + [("e", "1")] * 5,
        [("a", "2"), ("a", "3"), ("a", "2"), ("b", "2"), (None, "1"), ("c", None), ("d", "1"), ("d", "1")]
        + [("e", "1")] * 3)]
    assert sorted(((r.name or "", r.state) for r in archive.verify(*sides).collect())) == sorted(
        [("", "same"), ("a", "same"), ("a", "same"), ("a", "changed"), ("b", "changed"), ("c", "same"),
         ("d", "same"), ("d", "missing")] + [("e", "same")] * 3 + [("e", "new")] * 2)


@pytest.fixture()
def store(spark, tmp_path, facts_of):
    catalog = spark.createDataFrame([("d", None, True, None)], DATASETS)
    return str(tmp_path / "store"), catalog


LOAD = [("A", "x", 1.0, "2020-01-01", "2020-02-01"), ("A", "x", 2.0, "2020-01-01", "2020-03-01"),
        ("A", "x", 2.0, "2020-01-01", "2020-03-01")]


def test_versions_are_immutable_numbered_and_idempotent(spark, store, facts_of):
    root, catalog = store
    load = facts_of(LOAD).drop("version_number")
    assert versions.append_facts(spark, root, "d", load, catalog) == "d@v1"
    assert versions.append_facts(spark, root, "d", load.repartition(3), catalog) == "d@v1"
    more = facts_of([("A", "x", 3.0, "2020-01-01", "2020-04-01"),
                     ("B", "x", 1.0, "2020-01-01", "2020-04-01")]).drop("version_number")
    assert versions.append_facts(spark, root, "d", more, catalog) == "d@v2"
    stored = versions.read_facts(spark, root, "d")
    assert stored.count() == 5
    ids = [r.fact_id for r in versions.fact_ids(stored).collect()]
    assert len(set(ids)) == 5 and all(i.startswith(("d@v1#", "d@v2#")) for i in ids)
    assert stored.where("is_restatement").count() == 3
    listed = versions.versions(spark, root, "d").collect()
    assert [(r.version_number, r.row_count, str(r.knowledge_date)) for r in listed] == [
        (1, 3, "2020-03-01"), (2, 2, "2020-04-01")]
    assert versions.current_versions(versions.versions(spark, root)).first().version_id == "d@v2"


def test_half_written_versions_are_invisible_and_replaced(spark, store, facts_of):
    root, catalog = store
    load = facts_of(LOAD).drop("version_number")
    versions.append_facts(spark, root, "d", load, catalog)
    # What a load that died before its catalogue row leaves behind.
    orphan = versions.read_facts(spark, root, "d").withColumn("version_number", F.lit(2))
    orphan.write.mode("append").partitionBy("dataset_id", "version_number").parquet(f"{root}/facts")
    assert versions.read_facts(spark, root, "d").count() == 3
    more = facts_of([("B", "x", 1.0, "2020-01-01", "2020-04-01")]).drop("version_number")
    assert versions.append_facts(spark, root, "d", more, catalog) == "d@v2"
    assert versions.read_facts(spark, root, "d").count() == 4


def test_two_loads_at_once_get_two_numbers_and_lose_nothing(spark, store, facts_of, monkeypatch):
    root, catalog = store
    first = facts_of([("A", "x", 1.0, "2020-01-01", "2020-02-01")]).drop("version_number")
    second = facts_of([("A", "x", 2.0, "2020-01-01", "2020-03-01")]).drop("version_number")
    inside, whole = [], versions._write

    def interleaved(*args):
        folders = whole(*args)
        if not inside:  # while the second load is written, the first one begins and ends
            inside.append(True)
            inside.append(versions.append_facts(spark, root, "d", first, catalog))
        return folders

    monkeypatch.setattr(versions, "_write", interleaved)
    assert versions.append_facts(spark, root, "d", second, catalog) == "d@v2"
    assert inside[1] == "d@v1"
    stored = {(r.version_number, r.value, r.is_restatement)
              for r in versions.read_facts(spark, root, "d").collect()}
    assert stored == {(1, 1.0, False), (2, 2.0, True)}  # marked against the load that came first
    assert [r.version_number for r in versions.versions(spark, root, "d").collect()] == [1, 2]


def test_marking_reads_the_index_and_no_fact_file(spark, store, facts_of, tmp_path):
    root, catalog = store
    many = [(f"E{i}", "x", float(i), "2020-01-01", "2020-02-01") for i in range(300)]
    versions.append_facts(spark, root, "d", facts_of(many).drop("version_number"), catalog)
    shutil.move(f"{root}/facts", f"{tmp_path}/away")  # no fact can be read
    late = facts_of([("E7", "x", 7.0, "2020-01-01", "2020-03-01"), ("E8", "x", 9.0, "2020-01-01", "2020-03-01"),
                     ("E9", "x", 5.0, "2020-01-01", "2020-01-15")]).drop("version_number")
    assert versions.append_facts(spark, root, "d", late, catalog) == "d@v2"
    marked = {r.entity_id: r.is_restatement for r in spark.read.parquet(f"{root}/facts").collect()}
    assert marked == {"E7": False, "E8": True, "E9": True}
    own = sorted({r.bucket for r in versions._bucketed(late).select("bucket").collect()})
    read = versions.first_values(spark, root, "d", own)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.bucket for r in read.collect()} == set(own)
    index = versions.first_values(spark, root, "d").where("version_number = 2").collect()
    assert [(r.entity_id, r.value) for r in index] == [("E9", 5.0)]  # known earlier: now first


def test_marks_are_those_of_the_whole_history(spark, store, facts_of):
    import random
    from factmark.operators.bitemporal import mark_restatements
    root, catalog = store
    r, history = random.Random(6), None
    for number in range(1, 5):
        rows = [(r.choice("ABC"), "x", float(r.randrange(3)), f"2020-01-0{r.randrange(1, 4)}",
                 f"2020-0{r.randrange(2, 6)}-01") for _ in range(12)]
        load = facts_of(rows, version=number)
        want = mark_restatements(load, history)
        history = load if history is None else history.union(load)
        versions.append_facts(spark, root, "d", load.drop("version_number"), catalog)
        columns = ["entity_id", "value", "effective_date", "knowledge_date", "is_restatement"]
        got = versions.read_facts(spark, root, "d").where(f"version_number = {number}")
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(
            map(tuple, want.select(columns).collect()))


def test_reads_of_datasets_that_are_not_point_in_time_are_refused(spark, store, facts_of):
    root, catalog = store
    odd = "a/b 1%=é"
    both = catalog.union(spark.createDataFrame([(odd, None, False, "no vintages")], DATASETS))
    for name in ("d", odd):
        versions.append_facts(spark, root, name, facts_of(LOAD).drop("version_number"), both)
    assert versions.read(spark, root, "d", both).count() == 3
    assert versions.read_facts(spark, root, odd).count() == 3
    for name in (odd, "nowhere"):
        with pytest.raises(PointInTimeError):
            versions.read(spark, root, name, both)


def test_digests_name_the_buckets_that_differ(spark, facts_of):
    from factmark.operators import fingerprint
    rows = [(f"E{i}", "x", 0.1 * i, "2020-01-01", "2020-02-01") for i in range(50)] * 2
    one, other = facts_of(rows), facts_of(rows[:7] + rows[8:] + [rows[8]])
    digests = [fingerprint.bucket_digests(d, ["entity_id"], 16) for d in (one, other)]
    differ = fingerprint.differing_buckets(*digests, []).collect()
    where = {r.bucket for r in one.where("entity_id IN ('E7', 'E8')").select(
        fingerprint.key_bucket(["entity_id"], 16).alias("bucket")).collect()}
    assert {r.bucket for r in differ} == where
    same = [fingerprint.fingerprint(d).first().content_hash for d in (one, one.repartition(7))]
    assert same[0] == same[1] != fingerprint.fingerprint(other).first().content_hash
    split = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "~"), ("~", None)], "p string, q string")
    texts = [r[0] for r in split.select(fingerprint.row_text(["p", "q"])).collect()]
    assert len(set(texts)) == 4


def test_empty_and_unregistered_loads_are_refused(spark, store, facts_of):
    root, catalog = store
    with pytest.raises(ResearchError):
        versions.append_facts(spark, root, "d", facts_of([]).drop("version_number"), catalog)
    with pytest.raises(PointInTimeError):
        versions.append_facts(spark, root, "other", facts_of(LOAD), catalog)
    assert versions.versions(spark, root).count() == 0


def test_no_line_and_no_file_is_lost(spark, tmp_path):
    (tmp_path / "S P+500.csv").write_text("observation_date,X\n2020-01-01,5\n,7\n2020-01-03,.\nwrong,1\n")
    good, bad = observations.observation_facts(spark, str(tmp_path))
    assert [(r.entity_id, r.value) for r in good.collect()] == [("S P+500", 5.0)]
    assert sorted((r.observed or "", r.raw) for r in bad.collect()) == [("", "7"), ("wrong", "1")]
    good, bad = observations.vintage_facts(spark, str(tmp_path), entity_pattern=r"([^/]+)\.csv$")
    assert good.count() == 0
    assert {r.reason for r in bad.collect()} == {"not a date and a number", "no vintage date in the path"}
    assert bad.count() == 3


def test_a_concept_document_answers_for_its_own_tag(spark):
    payload = json.dumps({"cik": 1, "taxonomy": "us-gaap", "tag": "StockholdersEquity",
                          "units": {"USD": [_record("2020-12-31", 5.0, "2021-02-01")]}})
    documents = spark.createDataFrame([("CIK1", 1, payload)], "entity_id string, cik long, payload string")
    assert [r.field for r in filings.filing_facts(documents).collect()] == ["book_equity"]


def test_a_load_with_a_fact_that_cannot_be_stored_is_refused(spark, tmp_path):
    catalog = spark.createDataFrame([("d", None, True, None)], DATASETS)
    for entity, known in (("a", "2019-01-01"), (None, "2020-02-01")):
        facts = spark.sql(f"SELECT {'NULL' if entity is None else repr(entity)} AS entity_id, 'x' AS field, "
                          f"1D AS value, DATE '2020-01-01' AS effective_date, DATE '{known}' AS knowledge_date")
        with pytest.raises(PointInTimeError):
            versions.append_facts(spark, str(tmp_path / "s"), "d", facts, catalog)
    assert versions.versions(spark, str(tmp_path / "s")).count() == 0


def test_companies_without_a_line_are_considered(spark, tmp_path):
    """Against its SQL on orders of which some, and all of some companies, have no lines."""
    import __spark_entry__ as driver
    from parity import compare, duck
    sf = "/root/testdata/sf0.01"
    for name in ("orders", "lineitem"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "lineitem":
            lost = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey % 10 = 3")
            rows = rows.join(lost, rows.l_orderkey == lost.o_orderkey, "left_anti")
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duck(sf)
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = driver.queries()["universe_to_churn"](spark, str(tmp_path))
    cursor = con.execute(driver.oracle_sql()["universe_to_churn"])
    assert compare(df.collect(), df.columns, cursor.fetchall(), [d[0] for d in cursor.description]) == []
