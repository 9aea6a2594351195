"""Purged, embargoed cross-validation and the measurement of what a naive split leaks.

Folds follow from a row's index and its series' length, so assigning them needs no
window; each fold is then described by one row of bounds, and every question is a
join of labels with those few rows followed by a map-side aggregate. There is no
option that skips the purge.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LeakageError, ResearchError
from ..session import materialise
from .ordering import fold_of, with_position


def index_labels(labels: DataFrame, order: list[str]) -> DataFrame:
    """Give unindexed labels their 0-based ``idx`` in time order inside each series."""
    return with_position(labels, order, ["series_id"], "idx")


def label_problems(labels: DataFrame, n_splits: int) -> DataFrame:
    """(series_id, reason, rows) for labels that cannot be split."""
    backward = (labels.where(F.col("t1") < F.col("t0"))
                .groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
                .select("series_id", F.lit("label ends before it starts").alias("reason"), "rows"))
    short = (labels.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
             .where(F.col("rows") < n_splits)
             .select("series_id", F.lit("fewer rows than folds").alias("reason"), "rows"))
    # Neighbours meet by (series, index), so a long series is spread over all tasks.
    follower = labels.select("series_id", (F.col("idx") - 1).alias("idx"),
                             F.col("t0").alias("next_t0"))
    unsorted = (labels.join(follower, ["series_id", "idx"])
                .where(F.col("next_t0") < F.col("t0"))
                .groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
                .select("series_id", F.lit("t0 is not ascending").alias("reason"), "rows"))
    return backward.unionByName(short).unionByName(unsorted)


def split_labels(labels: DataFrame, n_splits: int) -> tuple[DataFrame, DataFrame]:
    """(labels of series that can be split, refused labels with every reason)."""
    problems = materialise(label_problems(labels, n_splits).groupBy("series_id").agg(
        F.array_sort(F.collect_set("reason")).alias("reasons")), "refused")  # three at most
    return (labels.join(problems, "series_id", "left_anti"),
            labels.join(problems, "series_id"))


def _assigned(labels: DataFrame, n_splits: int) -> DataFrame:
    if n_splits < 2:
        raise ResearchError(f"{n_splits} folds leave no rows to train on")
    sizes = materialise(labels.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return labels.join(sizes, "series_id").withColumn(
        "own_fold", fold_of(F.col("idx"), F.col("n"), n_splits))


def fold_bounds(labels: DataFrame, n_splits: int = 5, embargo_pct: float = 0.01) -> DataFrame:
    """One row per series with an array of its fold windows.

    A test window ends when its last label is settled. The embargo counts rows after
    the fold's last one, whatever time they cover.
    """
    if not 0.0 <= embargo_pct < 0.5:
        raise ResearchError(f"an embargo of {embargo_pct} is not a share below one half")
    bounds = _assigned(labels, n_splits).groupBy("series_id", "n", "own_fold").agg(
        F.min("t0").alias("test_start"), F.max("t1").alias("test_end"),
        F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n_test"))
    span = F.floor(F.col("n") * embargo_pct)
    # At most n_splits structs per series; written, so that rows meet it in a plain join
    # (see bitemporal.mark_restatements) and it is found once.
    return materialise(bounds.groupBy("series_id", "n").agg(F.collect_list(F.struct(
        F.col("own_fold").alias("fold"), "test_start", "test_end", "last_idx", "n_test",
        (F.col("last_idx") + span).alias("embargo_end"))).alias("folds")), "bounds")


ROLES = ("test", "purged", "embargoed", "train")


def purged_folds(labels: DataFrame, n_splits: int = 5, embargo_pct: float = 0.01,
                 roles: tuple[str, ...] = ROLES) -> DataFrame:
    """(series_id, fold, idx, role) with role test, purged, embargoed or train. Of the
    folds of a row only those in which it plays one of ``roles`` become rows."""
    bounds = fold_bounds(labels, n_splits, embargo_pct)
    played = F.filter(F.transform("folds", lambda f: F.struct(
        f["fold"].alias("fold"), _role(f, n_splits).alias("role"))),
        lambda f: f["role"].isin(*roles))
    return labels.join(bounds, "series_id").select("series_id", "idx", F.explode(played).alias("f")) \
        .select("series_id", "f.fold", "idx", "f.role")


def checked_folds(labels: DataFrame, n_splits: int = 5,
                  embargo_pct: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The folds of every series that can be split, and the series refused with all their
    reasons: labels that end before they start, are out of order or fewer than the folds,
    and series of which some fold is left without training rows."""
    fit, bad = split_labels(labels, n_splits)
    bad = bad.select("series_id", "reasons").distinct()
    folds = materialise(purged_folds(fit, n_splits, embargo_pct), "folds")
    empty = materialise(fold_sizes(folds).where("NOT usable").groupBy("series_id").agg(
        F.array(F.concat(F.lit("nothing to train on in fold "), F.concat_ws(
            ", ", F.array_sort(F.collect_list(F.col("fold").cast("string")))))).alias("reasons")),
        "empty-folds")
    return folds.join(empty, "series_id", "left_anti"), bad.unionByName(empty)


def _role(fold: Column, n_splits: int) -> Column:
    own = fold_of(F.col("idx"), F.col("n"), n_splits)
    overlaps = (F.col("t0") <= fold["test_end"]) & (F.col("t1") >= fold["test_start"])
    embargoed = F.col("idx").between(fold["last_idx"] + 1, fold["embargo_end"])
    return (F.when(own == fold["fold"], "test").when(overlaps, "purged")
            .when(embargoed, "embargoed").otherwise("train"))


def fold_sizes(folds: DataFrame) -> DataFrame:
    """Rows per role in every fold; a fold without training rows cannot be used."""
    count = lambda role: F.sum((F.col("role") == role).cast("long")).alias(role)
    sizes = folds.groupBy("series_id", "fold").agg(
        count("train"), count("test"), count("purged"), count("embargoed"))
    return sizes.withColumn("usable", F.col("train") > 0)


def leakage_report(labels: DataFrame, n_splits: int = 5, embargo_pct: float = 0.01) -> DataFrame:
    """What naive folds would leak, and what purge and embargo remove, per series."""
    rows = labels.join(fold_bounds(labels, n_splits, embargo_pct), "series_id")
    roles = F.transform("folds", lambda f: _role(f, n_splits))  # never a row per fold
    count = lambda *names: F.sum(F.size(F.filter(
        roles, lambda r: r.isin(*names))).cast("long"))
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("observations"),
        count("purged").alias("would_leak_under_naive_kfold"),
        count("purged", "embargoed").alias("removed_by_purge_and_embargo"),
    ).withColumn("leak_rate_naive", F.col("would_leak_under_naive_kfold")
                 / (F.col("observations") * n_splits))


def leakage(split: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows of any splitter's output whose label overlaps the test window.

    ``split`` is (series_id, fold, idx, role). One row per leaking fold.
    """
    rows = split.where(F.col("role").isin("train", "test")).join(labels, ["series_id", "idx"])
    test = F.col("role") == "test"
    windows = rows.groupBy("series_id", "fold").agg(
        F.min(F.when(test, F.col("t0"))).alias("test_start"),
        F.max(F.when(test, F.col("t1"))).alias("test_end"), F.count(F.lit(1)).alias("n"))
    windows = materialise(windows.drop("n"), "windows")
    return (rows.where(~test).join(windows, ["series_id", "fold"])
            .where((F.col("t0") <= F.col("test_end")) & (F.col("t1") >= F.col("test_start")))
            .groupBy("series_id", "fold")
            .agg(F.count(F.lit(1)).alias("leaking_rows"), F.min("idx").alias("first_idx")))


def assert_no_leakage(split: DataFrame, labels: DataFrame) -> None:
    for row in leakage(split, labels).orderBy("series_id", "fold").take(1):
        raise LeakageError(f"series {row.series_id!r}, fold {row.fold}: {row.leaking_rows} "
                           f"training rows overlap the test window, first idx {row.first_idx}")


def lookahead_audit(decisions: DataFrame, inputs: DataFrame) -> DataFrame:
    """Decisions that could see later data, or more rows than were delivered to them.

    ``decisions`` is (decision_id, ts, delivered); ``inputs`` is (decision_id, ts).
    """
    seen = inputs.groupBy("decision_id").agg(
        F.max("ts").alias("newest_input"), F.count(F.lit(1)).alias("visible"))
    audit = decisions.join(seen, "decision_id", "left").select(
        "decision_id", "ts", "newest_input", "delivered",
        F.coalesce("visible", F.lit(0)).alias("visible"),
        F.coalesce(F.col("newest_input") > F.col("ts"), F.lit(False)).alias("future_visible"))
    return audit.withColumn("extra_visible", F.col("visible") > F.col("delivered"))
