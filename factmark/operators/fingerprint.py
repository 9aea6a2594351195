"""Order-insensitive content hashes of DataFrames, and replay checks built on them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[str]) -> Column:
    """A row as text that no other row has: each value with its length before it, ``~``
    for null. Doubles are written with the fewest digits that tell them apart."""
    return F.concat(*[F.coalesce(F.concat(
        F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")),
        F.lit("~")) for c in columns])


def multiset_hash(columns: list[str]) -> Column:
    """Aggregate: MD5 over the count and the sums of both halves of each row's MD5.

    Any engine with MD5 and whole numbers of 38 digits computes the same. Partial results
    combine map-side, neither row order nor partitioning matters, and a sum keeps repeated
    rows that an xor would cancel.
    """
    digest = F.md5(row_text(columns))
    halves = [F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)"))
              .cast("decimal(38,0)") for at in (1, 17)]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in (F.count(F.lit(1)), *halves)]))


def key_bucket(columns: list[str], buckets: int) -> Column:
    """Which of ``buckets`` a key falls into, the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(row_text(columns)), 1, 8), 16, 10).cast("long"),
                  F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, key: list[str], buckets: int = 64,
                   group: list[str] = (), digits: int | None = None) -> DataFrame:
    """A fingerprint per bucket of keys: two runs that differ name the buckets where."""
    return fingerprint(df.withColumn("bucket", key_bucket(key, buckets)), [*group, "bucket"], digits)


def differing_buckets(recorded: DataFrame, recomputed: DataFrame, key: list[str]) -> DataFrame:
    """Buckets whose digests differ, or that one side lacks, with both row counts."""
    sides = [df.select(*key, "bucket", F.col("row_count").alias(f"{name}_rows"),
                       F.col("content_hash").alias(f"{name}_hash"))
             for name, df in (("recorded", recorded), ("recomputed", recomputed))]
    both = sides[0].join(sides[1], [*key, "bucket"], "full")
    return both.where(~F.col("recorded_hash").eqNullSafe(F.col("recomputed_hash"))).select(
        *key, "bucket", *(F.coalesce(f"{n}_rows", F.lit(0)).alias(f"{n}_rows")
                          for n in ("recorded", "recomputed")))


def fingerprint(df: DataFrame, group: list[str] = (), digits: int | None = None) -> DataFrame:
    """Hash of a result set (columns in name order), optionally one per group.

    ``digits`` hashes doubles at that many significant digits. Sums merged in another
    task order differ in the last bit; a replay of aggregates has to look past that.
    """
    if digits is not None:
        df = df.select(*[
            F.format_string(f"%.{digits - 1}e", f.name).alias(f.name)
            if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
    columns = sorted(c for c in df.columns if c not in group)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("row_count"),
                                  multiset_hash(columns).alias("content_hash"))


def replay_check(recorded: DataFrame, recomputed: DataFrame, key: list[str]) -> DataFrame:
    """Recorded and recomputed fingerprints side by side; missing ones do not reproduce."""
    again = recomputed.select(*key, F.col("content_hash").alias("replayed_hash"))
    return recorded.join(again, key, "left").withColumn(
        "reproduced", F.coalesce(F.col("content_hash") == F.col("replayed_hash"), F.lit(False)))
