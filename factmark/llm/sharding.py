"""Shards of nearly equal bytes whose equal texts stay together."""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .copies import HOT, numbered

#: A group of equal texts above 1 / (shards * ALONE) of all bytes is placed by itself, so
#: there are fewer than shards * ALONE such groups.
ALONE = 2048
#: Smaller groups are placed by the bucket their hash falls into.
BUCKETS = 16_384
#: Rows of a shard numbered in one task, on average.
NUMBERED = 50_000


def longest_first(items: list[tuple], shards: int) -> dict:
    """Longest-processing-time scheduling of ``(key, size)``: the largest first, each to
    the least loaded shard (equal loads: the lower one). Equal sizes go by key."""
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[key] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def shard_by_size(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put documents into ``shards`` shards of nearly equal size.

    A row's size is the UTF-8 bytes of its text plus 8; a null text counts as the empty
    one. Returns per row ``doc_id``, ``size``, ``text_crc32``, ``law`` ("bytes"), ``shard``,
    ``slot`` (gapless from 0 in its shard, by a hash and then ``doc_id``) and
    ``grown_shard`` (null: the law of sizes places all rows anew for another number of
    shards). Equal texts form a group and share a shard. A group above a shard's fair
    share stays whole, and its shard then holds it alone or nearly so. Null ids and
    repeated rows are placed like any other, rows equal in all columns being
    interchangeable; other columns are ignored; an empty table gives an empty result.

    How: groups are counted by hash (aggregated before the shuffle, so that copies of one
    text are one row per task). Longest-processing-time scheduling runs over a heap on the
    driver, whose input is bounded for any table: groups above 1 / (shards * ALONE) of all
    bytes each, and the others by BUCKETS hash buckets. The two lookup tables that come
    back have that bound too and are broadcast. Slots are counted by (shard, part), as
    many parts as keep a task near NUMBERED rows, and offset by the parts before.
    """
    spark = docs.sparkSession
    checkpoint_root(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash")).checkpoint()
    groups = rows.groupBy("hash", "text_crc32", "size").agg(F.count("*").alias("n")) \
        .withColumn("bytes", F.col("n") * F.col("size"))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    alone = F.col("bytes") > (total or 0) // (shards * ALONE)
    bucket = F.pmod("hash", F.lit(BUCKETS)).cast("int")
    key = ["hash", "text_crc32", "size"]
    items = groups.select(
        *(F.when(alone, F.col(c)).alias(c) for c in key),
        F.when(~alone, bucket).alias("bucket"), "bytes") \
        .groupBy(*key, "bucket").agg(F.sum("bytes").alias("bytes")).collect()
    # A large group is named by its key, a bucket by its number.
    placed = longest_first([((r.bucket is None, r.bucket or 0, r.hash or 0, r.text_crc32 or 0,
                              r.size or 0), r.bytes) for r in items], shards)
    own = pd.DataFrame([(*k[2:], s) for k, s in placed.items() if k[0]],
                       columns=[*key, "own"]).astype("int64")
    by_bucket = pd.DataFrame([(k[1], s) for k, s in placed.items() if not k[0]],
                             columns=["bucket", "common"]).astype("int64")
    own = spark.createDataFrame(own, "hash long, text_crc32 long, size long, own int")
    by_bucket = spark.createDataFrame(by_bucket, "bucket int, common int")

    parts = 1 + count // (shards * NUMBERED)
    put = (rows.join(F.broadcast(own), key, "left").withColumn("bucket", bucket)
           .join(F.broadcast(by_bucket), "bucket", "left")
           .select("doc_id", "size", "text_crc32", "hash",
                   F.coalesce("own", "common").alias("shard"),
                   F.xxhash64("doc_id", "hash").alias("same")))
    put = (numbered(put, "same").withColumn("part", F.pmod(
        F.xxhash64("same", F.floor(F.col("_copy") / HOT)), F.lit(parts)))
        .drop("same", "_copy").checkpoint())
    before = put.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part",  # at most `parts` rows a shard
        (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "hash"))
    return (put.withColumn("place", place).join(before, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("place") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
