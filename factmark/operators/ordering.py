"""Exact positions and quantiles of data that must not land in one task.

A window without partition columns, or over a group holding a third of the rows,
sorts that group in a single task. ``with_position`` range-partitions on the sort
key instead, so a large group is spread over as many tasks as its rows need, and
adds per-(task, group) offsets afterwards. Quantiles need no order at all: they are
found by counting.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Scratch, materialise


def with_position(df: DataFrame, order: list[str], group: list[str] = (),
                  position: str = "position", size: str | None = None,
                  weight: str | None = None) -> DataFrame:
    """Add the 0-based rank of each row inside its group; optionally the group size.

    ``order`` should identify a row inside its group: equal rows are ranked arbitrarily
    and cannot be spread over tasks. Where copies abound, aggregate them first and give
    their count as ``weight``: the position is then that of the first copy.
    The sorted rows are written once because range bounds are sampled: offsets and rows
    must come from the same layout, and the offsets read only its key columns.
    """
    group = list(group)
    keys = group + list(order)
    heavy = F.col(weight) if weight else F.lit(1)
    laid_out = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()), "ranked")
    pieces = laid_out.groupBy("_task", *group).agg(
        F.sum(heavy).alias("_n"), F.min("_row").alias("_first"))
    # One row per (task, group): at most #tasks rows for any one group, so this
    # window is small even where the group itself is not.
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = whole.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        "_task", *group, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"))
    inside = F.col("_row") - F.col("_first")
    out = laid_out
    if weight:
        piece = (W.partitionBy("_task", *group).orderBy("_row")
                 .rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn("_inside", F.coalesce(F.sum(weight).over(piece), F.lit(0)))
        inside = F.col("_inside")
    columns = [F.col(c) for c in df.columns]
    columns.append((F.col("_before") + inside).alias(position))
    if size:
        columns.append(F.col("_size").alias(size))
    return out.join(offsets, ["_task", *group]).select(*columns)


#: Cells of a histogram, and rows that one task may sort to finish a quantile.
CELLS, SORTED = 2048, 20_000


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], group: list[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles, exact at any size: (group, probability, quantile).

    Nothing is sorted but what is left at the end. The range that holds a quantile's two
    ranks is cut into CELLS, counted in one aggregation, and narrowed to the smallest and
    largest value of the cell they fall into; where they fall into two, they are the end of
    one and the start of the next. After a round or two a range holds at most SORTED rows,
    or a single value. ``weight`` counts a row as so many equal ones. Nulls and NaN are left
    out; a group without values has no row.
    """
    group = list(group)
    heavy = (F.col(weight) if weight else F.lit(1)).cast("long")
    data = df.where(F.col(value).isNotNull()).select(
        *group, F.col(value).cast("double").alias("_v"), heavy.alias("_w")).where("_w > 0 AND NOT isnan(_v)")
    rank = F.col("probability") * (F.col("_size") - 1)
    state = (data.groupBy(*group).agg(F.sum("_w").alias("_size"), F.min("_v").alias("_lo"),
                                      F.max("_v").alias("_hi"))
             .where("_size > 0")
             .select("*", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"))
             .select(*group, "probability", F.floor(rank).alias("_k0"), F.ceil(rank).alias("_k1"),
                     (rank - F.floor(rank)).alias("_part"), F.lit(0).cast("long").alias("_before"),
                     F.col("_size").alias("_inside"), "_lo", "_hi",
                     F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_q0"),
                     F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_q1")))
    key, known = [*group, "probability"], F.col("_q0").isNotNull()
    with Scratch(df.sparkSession, "quantiles") as scratch:
        state = scratch.table(state)
        while not state.where(~known & (F.col("_inside") > SORTED)).isEmpty():
            wide = state.where(~known & (F.col("_inside") > SORTED))
            cells = _in_range(data, wide, group).groupBy(*key, _cell().alias("_cell")).agg(
                F.sum("_w").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
            upto = W.partitionBy(*key).orderBy("_cell")  # at most CELLS rows
            cells = cells.withColumn("_upto", F.sum("_n").over(upto)).join(
                wide.select(*key, "_k0", "_k1", "_before"), key)
            end = F.col("_before") + F.col("_upto")
            holds = lambda k: (F.col(k) < end) & (F.col(k) >= end - F.col("_n"))
            here = F.struct((end - F.col("_n")).alias("start"), "_n", "_least", "_most")
            found = cells.groupBy(*key).agg(F.max(F.when(holds("_k0"), here)).alias("a"),
                                            F.max(F.when(holds("_k1"), here)).alias("b"))
            one = F.col("a.start") == F.col("b.start")
            low = F.when(~one | (F.col("a._least") == F.col("a._most")), F.col("a._most"))
            high = F.when(~one, F.col("b._least")).when(F.col("a._least") == F.col("a._most"), F.col("a._most"))
            narrowed = wide.drop("_before", "_inside", "_lo", "_hi", "_q0", "_q1").join(found, key).select(
                *key, "_k0", "_k1", "_part", F.col("a.start").alias("_before"), F.col("a._n").alias("_inside"),
                F.col("a._least").alias("_lo"), F.col("a._most").alias("_hi"), low.alias("_q0"), high.alias("_q1"))
            state = scratch.table(state.where(known | (F.col("_inside") <= SORTED)).unionByName(narrowed))
        left = state.where(~known)
        values = _in_range(data, left, group).groupBy(*key, "_v").agg(F.sum("_w").alias("_n"))
        upto = W.partitionBy(*key).orderBy("_v")  # at most SORTED rows
        placed = values.withColumn("_upto", F.sum("_n").over(upto)).join(
            left.select(*key, "_k0", "_k1", "_before"), key)
        end = F.col("_before") + F.col("_upto")
        at = lambda k: F.max(F.when((F.col(k) < end) & (F.col(k) >= end - F.col("_n")),
                                    F.col("_v")))
        last = placed.groupBy(*key).agg(at("_k0").alias("_q0"), at("_k1").alias("_q1")).join(
            left.select(*key, "_part"), key)
        columns = [*key, "_q0", "_q1", "_part"]
        ends = scratch.table(state.where(known).select(columns).unionByName(last.select(columns)), kept=True)
    return ends.select(*key, (F.col("_q0") + (F.col("_q1") - F.col("_q0")) * F.col("_part"))
                       .alias("quantile"))


def _in_range(data: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Rows of the data with each range of their group that they lie in."""
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    if group:
        return data.join(ranges.select(*group, "probability", "_lo", "_hi"), group).where(inside)
    listed = ranges.select("probability", "_lo", "_hi").collect()  # a row per probability asked for
    if not listed:
        return data.select("*", *[F.lit(None).cast("double").alias(c)
                                  for c in ("probability", "_lo", "_hi")]).where("false")
    all_ = F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("probability", "_lo", "_hi")])
                               for r in listed])).alias("_r")
    return data.select("*", all_).select(*data.columns, "_r.*").where(inside)


def _cell() -> Column:
    """Which of CELLS equal parts of its range a value lies in; of the range's logarithm
    where that is the evener division."""
    v, low, high = F.col("_v"), F.col("_lo"), F.col("_hi")
    endless = float("inf")
    part = (F.when((low == -endless) | (high == endless), F.when(v == -endless, 0.0)
                   .when(v == endless, 1.0).otherwise(0.5))
            .when((low > 0) & (high / 1000 > low), (F.ln(v) - F.ln(low)) / (F.ln(high) - F.ln(low)))
            .when((high < 0) & (low / 1000 < high), (F.ln(-low) - F.ln(-v)) / (F.ln(-low) - F.ln(-high)))
            .otherwise((v / 2 - low / 2) / (high / 2 - low / 2)))
    return F.least(F.greatest(F.floor(part * CELLS), F.lit(0)), F.lit(CELLS - 1))


def approximate_quantiles(df: DataFrame, value: str, probabilities: list[float],
                          group: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Quantiles from a sketch that merges map-side, in one pass: a value whose rank is off
    by at most 1 / ``accuracy`` of the rows."""
    probabilities = [float(p) for p in probabilities]
    sketch = F.percentile_approx(value, probabilities, accuracy)
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probabilities]).alias("probability"),
                         F.col("_q").alias("quantile"))
    return (df.groupBy(*group).agg(sketch.alias("_q")).where("_q IS NOT NULL")
            .select(*group, F.explode(pairs).alias("p"))
            .select(*group, F.col("p.probability").alias("probability"),
                    F.col("p.quantile").cast("double").alias("quantile")))


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery, instead of a cross join."""
    return df.select(F.struct("*").alias("row")).scalar()


def bucket_of(position: Column, size: Column, buckets: int) -> Column:
    """floor(position * buckets / size): the reference bucket rule, which is not NTILE."""
    return F.floor(position * F.lit(buckets) / size).cast("int")


def fold_of(position: Column, size: Column, folds: int) -> Column:
    """Contiguous fold of a 0-based position; the first ``size % folds`` are one longer."""
    small = F.floor(size / folds)
    longer = size % folds
    edge = longer * (small + 1)
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(
        longer + F.floor((position - edge) / F.greatest(small, F.lit(1)))).cast("int")
