"""What was known when: first reports, restatements, panels, rank churn."""
import pytest
from pyspark.sql import functions as F

from helpers import day
from factmark.errors import LookAheadContamination, PointInTimeError, ResearchError
from factmark.operators import bitemporal, universe, validation
from factmark.schemas import DATASETS

EPS = [("ACME", "eps", 1.20, "2023-09-30", "2023-11-02"),
       ("ACME", "eps", 0.85, "2023-09-30", "2024-02-20")]


def values(df):
    return sorted(r.value for r in df.collect())


def test_as_of_keeps_originals_and_the_restatements_known_by_then(facts_of):
    facts = facts_of(EPS)
    assert values(bitemporal.as_of(facts, "2023-10-01")) == []
    assert values(bitemporal.as_of(facts, "2023-12-01")) == [1.20]
    assert values(bitemporal.as_of(facts, "2024-03-01")) == [0.85, 1.20]
    assert values(bitemporal.as_of(facts, "2024-03-01", field="sales")) == []


def test_first_report_survives_the_revision(facts_of):
    facts = facts_of(EPS)
    for known_by in ("2023-12-01", "2024-03-01", None):
        assert values(bitemporal.first_reports(facts, known_by)) == [1.20]


def test_latest_needs_acknowledgement_and_carries_the_flag(facts_of):
    facts = facts_of(EPS)
    with pytest.raises(LookAheadContamination):
        bitemporal.latest_with_restatements(facts)
    row = bitemporal.latest_with_restatements(facts, acknowledge=True).first()
    assert (row.value, row.as_first_reported) == (0.85, 1.20)
    assert row.look_ahead_contaminated and row.differs_from_as_reported


def test_ties_go_to_the_earlier_version_then_the_lower_value(facts_of):
    tie = [("A", "x", 5.0, "2020-01-01", "2020-02-01"), ("A", "x", 4.0, "2020-01-01", "2020-02-01")]
    later = [("A", "x", 1.0, "2020-01-01", "2020-02-01")]
    facts = facts_of(tie).unionByName(facts_of(later, version=2))
    assert values(bitemporal.first_reports(facts)) == [4.0]


REVISED = [("A", "equity", 27.832, "2009-09-26", "2009-10-27"),
           ("A", "equity", 31.640, "2009-09-26", "2010-10-27"),
           ("A", "equity", 31.640, "2009-09-26", "2011-10-26"),
           ("A", "equity", 47.791, "2010-09-25", "2010-10-27")]


def flags(df):
    return sorted((str(r.effective_date), str(r.knowledge_date), r.is_restatement)
                  for r in df.collect())


def test_a_period_that_a_third_of_the_batch_revises(facts_of):
    rows = [("A", "x", float(i % 5), "2020-01-01", f"2020-03-{1 + i % 28:02d}") for i in range(300)]
    rows += [(f"E{i}", "x", 1.0, "2020-01-01", "2020-02-01") for i in range(600)]
    marked = bitemporal.mark_restatements(facts_of(rows)).collect()
    assert len(marked) == len(rows)
    assert all(r.is_restatement == (r.entity_id == "A" and r.value != 0.0) for r in marked)


def test_marking_reads_the_batch_and_its_baseline_once(facts_of):
    plan = bitemporal.mark_restatements(facts_of(REVISED))._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 2


def test_restatements_inside_one_batch(facts_of):
    marked = bitemporal.mark_restatements(facts_of(REVISED))
    assert flags(marked) == [("2009-09-26", "2009-10-27", False), ("2009-09-26", "2010-10-27", True),
                             ("2009-09-26", "2011-10-26", True), ("2010-09-25", "2010-10-27", False)]


def test_restatement_against_the_store_and_backfill(facts_of):
    stored = facts_of([("A", "x", 2.0, "2020-01-01", "2020-03-01")])
    # Known earlier, loaded later: still measured against what was stored first.
    backfill = facts_of([("A", "x", 1.0, "2020-01-01", "2020-02-01"),
                         ("A", "x", 2.0, "2020-01-01", "2020-04-01"),
                         ("B", "x", 9.0, "2020-01-01", "2020-04-01")], version=2)
    marked = {(r.entity_id, r.value): r.is_restatement
              for r in bitemporal.mark_restatements(backfill, stored).collect()}
    assert marked == {("A", 1.0): True, ("A", 2.0): False, ("B", 9.0): False}
    # Reads order by knowledge date, so the backfilled value is the first report.
    both = stored.unionByName(backfill).where("entity_id = 'A'")
    assert values(bitemporal.first_reports(both)) == [1.0]


def test_an_explicit_flag_wins(facts_of):
    batch = facts_of(EPS).withColumn("is_restatement", F.lit(None).cast("boolean")).withColumn(
        "is_restatement", F.when(F.col("value") == 1.20, True))
    assert flags(bitemporal.mark_restatements(batch)) == [
        ("2023-09-30", "2023-11-02", True), ("2023-09-30", "2024-02-20", True)]


def test_restatement_rate(facts_of):
    marked = bitemporal.mark_restatements(facts_of(
        REVISED + [("B", "equity", 1.0, "2010-01-01", "2010-02-01")]))
    row = bitemporal.restatement_rate(marked).first()
    assert (row.filers, row.restating_filers, row.restatement_rate) == (2, 1, 0.5)


RAGGED = [("SP500", "close", 1.0, "2020-04-17", "2020-04-17"),
          ("SP500", "close", 2.0, "2020-04-20", "2020-04-20"),
          ("SP500", "close", 3.0, "2020-04-21", "2020-04-21"),
          ("OIL", "close", 18.27, "2020-04-17", "2020-04-17"),
          ("OIL", "close", -36.98, "2020-04-20", "2020-04-20")]


def test_panels_are_never_filled(facts_of):
    observations = bitemporal.series(facts_of(RAGGED), "close")
    wide = bitemporal.wide_panel(observations, ["SP500", "OIL"]).orderBy("effective_date").collect()
    assert [(r.SP500, r.OIL) for r in wide] == [(1.0, 18.27), (2.0, -36.98), (3.0, None)]
    assert bitemporal.wide_panel(observations, ["SP500", "OIL"], complete_cases=True).count() == 2
    assert bitemporal.complete_dates(observations).count() == 4
    with pytest.raises(ResearchError):
        bitemporal.wide_panel(observations, [])
    cover = bitemporal.panel_coverage(observations).first()
    assert (cover.entities, cover.dates, cover.incomplete_dates) == (2, 3, 1)
    assert (cover.common_dates, cover.common_incomplete_dates) == (2, 0)


def test_non_positive_prices_are_named(facts_of):
    rows = bitemporal.non_positive(facts_of(RAGGED), "close").collect()
    assert [(r.entity_id, str(r.effective_date), r.value) for r in rows] == [
        ("OIL", "2020-04-20", -36.98)]
    assert bitemporal.non_positive_entities(facts_of(RAGGED), "close").first().observations == 1


def test_point_in_time_guard(spark):
    catalog = spark.createDataFrame([("good", None, True, None), ("bad", None, False, "no dates"),
                                     ("mute", None, False, " ")], DATASETS)
    bitemporal.require_point_in_time(catalog, "good")
    for name in ("bad", "unknown"):
        with pytest.raises(PointInTimeError):
            bitemporal.require_point_in_time(catalog, "good", name)
    assert [r.dataset_id for r in bitemporal.catalog_problems(catalog).collect()] == ["mute"]


def test_facts_known_before_their_period_are_rejected(spark, facts_of):
    facts = facts_of([("A", "x", 1.0, "2020-01-02", "2020-01-01"),
                      (None, "x", 1.0, "2020-01-01", "2020-01-01"),
                      ("A", "x", None, "2020-01-01", "2020-01-01")])
    good, bad = validation.split_facts(facts)
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["known before its period",
                                                       "missing entity_id"]


CROSS = [("100", "equity", 1000.0, "2014-12-31", "2015-03-01"),
         ("200", "equity", 2000.0, "2014-12-31", "2015-03-01"),
         ("300", "equity", 3000.0, "2014-12-31", "2015-03-01")]


@pytest.mark.parametrize("restated, moved", [(2400.0, 0), (9000.0, 2)])
def test_rank_churn(facts_of, restated, moved):
    facts = facts_of(CROSS + [("200", "equity", restated, "2014-12-31", "2016-03-01")])
    row = universe.rank_churn(facts, "equity", "2015-06-01", 3).first()
    assert (row.companies, row.restated, row.changed_bucket) == (3, 1, moved)
    assert row.spearman == pytest.approx(1.0 if not moved else 0.5)


def test_rank_churn_refuses_too_few_companies(facts_of):
    assert universe.rank_churn(facts_of(CROSS), "equity", "2015-06-01", 10).count() == 0


def test_buckets_are_not_ntile(spark):
    data = spark.createDataFrame([(str(i), float(i)) for i in range(7)], "entity_id string, v double")
    rows = universe.rank_and_bucket(data, "v", 5, "v").orderBy("v_rank").collect()
    assert [r.v_bucket for r in rows] == [0, 0, 1, 2, 2, 3, 4]


def test_universe_is_selected_by_number_before_data(spark):
    companies = spark.createDataFrame([(30,), (2,), (100,), (2,)], "cik long")
    assert [r.cik for r in universe.select_universe(companies, 2).collect()] == [2, 30]
    with pytest.raises(ResearchError):
        universe.select_universe(companies, 0)


def test_build_report_counts_what_it_left_out(spark, facts_of):
    candidates = spark.createDataFrame([("100",), ("200",), ("300",), ("400",)], "entity_id string")
    row = universe.build_report(candidates, facts_of(CROSS)).first()
    assert (row.considered, row.loaded, row.skipped_no_data, row.facts) == (4, 3, 1, 3)
    assert row.skip_rate == 0.25
    failed = spark.createDataFrame([("400",), ("100",)], "entity_id string")
    row = universe.build_report(candidates, facts_of(CROSS), failed).first()
    assert (row.skipped_no_data, row.skipped_error) == (0, 1)


def test_guarded_series_uses_the_range_of_the_data(spark, facts_of):
    from factmark.errors import HoldoutViolation
    from factmark.operators import ledger
    held = spark.createDataFrame([("macro", day("2010-01-01"), day("2010-12-31"))],
                                 "dataset_id string, start_date date, end_date date")
    observations = bitemporal.series(facts_of(REVISED), "equity")
    with pytest.raises(HoldoutViolation):
        ledger.guarded_series(observations, "macro", held)
    early = bitemporal.series(facts_of(REVISED), "equity", end="2009-12-31")
    assert ledger.guarded_series(early, "macro", held).count() == 1
    assert ledger.guarded_series(observations, "other", held).count() == 2
