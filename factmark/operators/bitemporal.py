"""Reads over facts with two time axes, and the marking of restatements."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LookAheadContamination, PointInTimeError, ResearchError
from .ordering import one_row
from ..session import materialise

KEY = ["entity_id", "field", "effective_date"]


def _day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def _narrow(facts: DataFrame, known_by=None, start=None, end=None,
            entity_id=None, field=None) -> DataFrame:
    for condition in (
            entity_id is not None and (F.col("entity_id") == entity_id),
            field is not None and (F.col("field") == field),
            known_by is not None and (F.col("knowledge_date") <= _day(known_by)),
            start is not None and (F.col("effective_date") >= _day(start)),
            end is not None and (F.col("effective_date") <= _day(end))):
        if condition is not False:
            facts = facts.where(condition)
    return facts


# --- guards ------------------------------------------------------------------

def point_in_time_refusals(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested datasets that may not be read, with the reason."""
    known = catalog.select("dataset_id", "point_in_time", "pit_note")
    reason = (F.when(F.col("point_in_time").isNull(), F.lit("not registered"))
              .when(~F.col("point_in_time"), F.concat(F.lit("not point-in-time: "),
                                                      F.coalesce("pit_note", F.lit("")))))
    return (requested.select("dataset_id").distinct().join(known, "dataset_id", "left")
            .select("dataset_id", reason.alias("reason")).where("reason IS NOT NULL"))


def require_point_in_time(catalog: DataFrame, *dataset_ids: str) -> None:
    """Refuse before any plan is built on an unregistered or non-PIT dataset."""
    wanted = catalog.sparkSession.createDataFrame([(d,) for d in dataset_ids],
                                                  "dataset_id string")
    for row in point_in_time_refusals(wanted, catalog).take(1):
        raise PointInTimeError(f"dataset {row.dataset_id!r}: {row.reason}")


def catalog_problems(catalog: DataFrame) -> DataFrame:
    """Datasets declared not point-in-time without saying what is missing."""
    note = F.coalesce(F.length(F.trim("pit_note")), F.lit(0))
    return catalog.where(~F.col("point_in_time") & (note == 0)).select("dataset_id")


# --- filters -----------------------------------------------------------------

def as_of(facts: DataFrame, known_by, entity_id: str | None = None,
          field: str | None = None, effective_on_or_before=None) -> DataFrame:
    """Every fact known by the date: originals and the restatements known by then."""
    return _narrow(facts, known_by, None, effective_on_or_before, entity_id, field)


def in_time_order(facts: DataFrame) -> DataFrame:
    return facts.orderBy("effective_date", "knowledge_date")


def non_positive(facts: DataFrame, field: str) -> DataFrame:
    """Observations no return can be formed from, one row each."""
    return (facts.where((F.col("field") == field) & (F.col("value") <= 0))
            .select("entity_id", "effective_date", "value"))


def non_positive_entities(facts: DataFrame, field: str) -> DataFrame:
    return non_positive(facts, field).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("observations"), F.min("effective_date").alias("first_date"),
        F.max("effective_date").alias("last_date"), F.min("value").alias("lowest"))


def restatements(facts: DataFrame) -> DataFrame:
    return facts.where("is_restatement")


# --- first and latest reports --------------------------------------------------

def _report_order() -> Column:
    """Ties on the knowledge date go to the earlier version, then the lower value.

    Both are properties of the data, so the choice does not depend on how a load was
    partitioned the way a row ordinal would.
    """
    return F.struct("knowledge_date", "version_number", "value")


def first_reports(facts: DataFrame, known_by=None, start=None, end=None,
                  keys: Sequence[str] = KEY) -> DataFrame:
    """The first reported value of every period, among facts known by the date.

    An aggregate, not a window: partial results are merged map-side, so a key
    repeated across a third of the table still ships one row per task.
    """
    first = F.min(_report_order()).alias("first")
    return (_narrow(facts, known_by, start, end).groupBy(*keys).agg(first)
            .select(*keys, F.col("first.value").alias("value"),
                    F.col("first.knowledge_date").alias("knowledge_date")))


def series(facts: DataFrame, field: str, known_by=None, start=None, end=None,
           entity_id: str | None = None) -> DataFrame:
    """As-first-reported observations of one field: a panel, never forward filled."""
    return first_reports(_narrow(facts, entity_id=entity_id, field=field), known_by, start, end
                         ).select("entity_id", "effective_date", "value")


def latest_with_restatements(facts: DataFrame, acknowledge: bool = False,
                             keys: Sequence[str] = KEY) -> DataFrame:
    """Last known value beside the first, flagged as contaminated by look-ahead."""
    if not acknowledge:
        raise LookAheadContamination(
            "latest values may be restated figures nobody had at the time; use "
            "first_reports, or pass acknowledge=True and carry the flag")
    ends = facts.groupBy(*keys).agg(F.max(_report_order()).alias("last"),
                                    F.min(_report_order()).alias("first"))
    return ends.select(
        *keys, F.col("last.value").alias("value"),
        F.col("last.knowledge_date").alias("knowledge_date"),
        F.col("first.value").alias("as_first_reported"),
        (~F.col("first.value").eqNullSafe(F.col("last.value"))
         ).alias("differs_from_as_reported"),
        F.lit(True).alias("look_ahead_contaminated"))


def honest_and_hindsight(facts: DataFrame, field: str, known_by) -> DataFrame:
    """Per entity: the latest period known by the date, first reported and as of today.

    One pass: each period is reduced to its first report and its last revision,
    then the newest period whose first report was already known is kept.
    """
    ends = (facts.where(F.col("field") == field).groupBy("entity_id", "effective_date")
            .agg(F.min(_report_order()).alias("first"), F.max(_report_order()).alias("last"))
            .where(F.col("first.knowledge_date") <= _day(known_by)))
    newest = F.max(F.struct("effective_date", F.col("first.value").alias("honest"),
                            F.col("last.value").alias("hindsight")))
    return (ends.groupBy("entity_id").agg(newest.alias("n"))
            .select("entity_id", "n.effective_date", "n.honest", "n.hindsight"))


# --- restatement marking ---------------------------------------------------------

def restatement_baseline(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The value each incoming period is compared with: stored first, else first in batch.

    ``n_incoming`` counts the batch rows behind each period.
    """
    in_batch = batch.groupBy(*KEY).agg(
        F.min(F.struct("knowledge_date", "value")).getField("value").alias("batch_value"),
        F.count(F.lit(1)).alias("n_incoming"))
    if stored is None:
        return in_batch.select(*KEY, F.col("batch_value").alias("baseline"),
                               F.lit(False).alias("already_stored"), "n_incoming")
    index = first_reports(stored).select(*KEY, F.col("value").alias("stored_value"),
                                         F.lit(True).alias("already_stored"))
    return in_batch.join(index, KEY, "left").select(
        *KEY, F.coalesce("stored_value", "batch_value").alias("baseline"),
        F.coalesce("already_stored", F.lit(False)).alias("already_stored"), "n_incoming")


def mark_restatements(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Flag rows whose value differs from the one first known for their period.

    A flag already present on the input wins; a row without a complete key has no
    baseline and stays. The baseline has one row per period and is written first, so
    that it meets the batch in a join of two plain relations: AQE splits a period that a
    third of the batch repeats, which it cannot where a side is an aggregate on the key.
    """
    base = materialise(restatement_baseline(batch, stored).select(*KEY, "baseline"), "baseline")
    revised = F.col("baseline").isNotNull() & ~F.col("value").eqNullSafe(F.col("baseline"))
    given = F.col("is_restatement") if "is_restatement" in batch.columns else F.lit(None)
    rest = [c for c in batch.columns if c not in (*KEY, "is_restatement")]
    return batch.join(base, KEY, "left").select(
        *KEY, *rest, F.coalesce(given.cast("boolean"), revised).alias("is_restatement"))


def restatement_rate(marked: DataFrame) -> DataFrame:
    """Share of entities with at least one restated period."""
    per_entity = marked.groupBy("entity_id").agg(
        F.max(F.col("is_restatement").cast("int")).alias("restated"))
    return per_entity.agg(F.count(F.lit(1)).alias("filers"),
                          F.sum("restated").alias("restating_filers"),
                          F.avg("restated").alias("restatement_rate"))


# --- panels ---------------------------------------------------------------------

def wide_panel(observations: DataFrame, entities: Sequence[str],
               complete_cases: bool = False) -> DataFrame:
    """One row per date and one column per entity; absent is NULL, never filled."""
    if not entities:
        raise ResearchError("a panel needs at least one entity")
    held = {r.entity_id for r in observations.where(F.col("entity_id").isin(list(entities)))
            .select("entity_id").distinct().collect()}  # at most those asked for
    if missing := [e for e in entities if e not in held]:
        raise ResearchError(f"nothing is stored for {', '.join(missing)}")
    wide = (observations.where(F.col("entity_id").isin(list(entities)))
            .groupBy("effective_date").pivot("entity_id", list(entities))
            .agg(F.first("value")))
    if not complete_cases:
        return wide
    whole = whole_dates(wide, entities)
    if whole.isEmpty():
        raise ResearchError("these entities share no date")
    return whole


def whole_dates(wide: DataFrame, entities: Sequence[str]) -> DataFrame:
    """The dates of a wide panel at which no entity is absent; there may be none."""
    return wide.na.drop("any", subset=list(entities))


def complete_dates(observations: DataFrame) -> DataFrame:
    """Long-form complete cases: dates on which every entity was observed."""
    universe = one_row(observations.agg(F.count_distinct("entity_id").alias("entities")))
    dates = (observations.groupBy("effective_date").agg(F.count(F.lit(1)).alias("n_observed"))
             .where(F.col("n_observed") == universe.getField("entities"))
             .select("effective_date"))
    return observations.join(dates, "effective_date", "left_semi")


def panel_coverage(observations: DataFrame) -> DataFrame:
    """How ragged a panel is: incomplete dates overall and inside the common window."""
    spans = (observations.groupBy("entity_id")
             .agg(F.min("effective_date").alias("lo"), F.max("effective_date").alias("hi"))
             .agg(F.count(F.lit(1)).alias("entities"), F.max("lo").alias("common_start"),
                  F.min("hi").alias("common_end")))
    dates = (observations.groupBy("effective_date").agg(F.count(F.lit(1)).alias("n_observed"))
             .select("*", one_row(spans).alias("span")))
    hole = F.col("n_observed") < F.col("span.entities")
    common = F.col("effective_date").between(F.col("span.common_start"),
                                             F.col("span.common_end"))
    counts = dates.groupBy("span").agg(
        F.count(F.lit(1)).alias("dates"),
        F.sum(hole.cast("long")).alias("incomplete_dates"),
        F.avg(hole.cast("double")).alias("incomplete_share"),
        F.sum(common.cast("long")).alias("common_dates"),
        F.sum((common & hole).cast("long")).alias("common_incomplete_dates"))
    return counts.select("span.*", *[c for c in counts.columns if c != "span"])
