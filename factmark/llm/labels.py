"""Labelled rows to learn from: never those whose id checksum leaves 2 modulo 4."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from; a null id is not one of them, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame, column: str, size: int, seed: int = 5) -> DataFrame:
    """``doc_id, label`` of about ``size`` learnable rows, chosen by a hash of the id (all
    of them where there are fewer). Rows without an id or a label of 0 or 1 are left out;
    an id with several labels counts once, with the largest. Its size is bounded by the
    parameter, so it may be broadcast."""
    usable = (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(column).cast("int").alias("label")))
    total = usable.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) * total
    return usable.where(share < size * (1 << 30)) if total > size else usable


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, text, label`` of the chosen documents; the ids are few and broadcast. Of
    rows that share an id one counts, so that the result is bounded by the ids."""
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one)
            .select("doc_id", F.col("one.text").alias("text"), "label"))
