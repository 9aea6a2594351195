"""Numbers for rows that are alike, so that many of them need not meet in one task."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

#: Rows of one key that a single task may hold.
HOT = 20_000


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_copy``: 0, 1, 2 ... among the rows of one ``key`` (a number, not
    null), or 0 throughout where no key has more than ``HOT`` rows.

    Which of the rows of a key has which number depends on how they are stored, so the key
    should tell apart rows that are not alike. Numbers are counted inside each task and
    offset by the tasks before; no task holds a whole key.
    """
    most = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= HOT:
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    held = materialise(rows.withColumn("_task", F.spark_partition_id())
                       .withColumn("_row", F.monotonically_increasing_id()), "copies")
    ahead = W.partitionBy(key).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    tasks = (held.groupBy(key, "_task").agg(F.count(F.lit(1)).alias("_n"))  # a row per task
             .select(key, "_task", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")))
    inside = F.row_number().over(W.partitionBy(key, "_task").orderBy("_row")) - 1
    return (held.withColumn("_inside", inside).join(tasks, [key, "_task"])
            .withColumn("_copy", F.col("_before") + F.col("_inside"))
            .select(*rows.columns, "_copy"))
