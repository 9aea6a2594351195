"""Exact top-k inner products by refining score histograms."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ResearchError
from ..session import checkpoint_root
from . import text as T

#: Candidates and queries scored together in one task.
CANDIDATES, QUERIES = 8192, 2048
#: Bits of a score that one round settles.
BITS = 12


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``vector``: ``floor(scale * x)`` of each component as double. Rows
    without an id, without components, or with a null or non-finite one are left out; rows
    that share an id stay rows of their own."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector")))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` highest integer inner products of each query with every other row.

    ``vectors`` has ``vec_id`` and an integer array ``vector`` (see ``quantised``). Queries
    are the rows whose id is divisible by ``every``; rows of one id are queries and
    candidates each for themselves. Returns ``query_id``, ``rank`` (from
    1), ``vec_id``, ``score``; equal scores go to the smaller id; a query with fewer
    candidates gets them all. Only vectors of the query's length are its candidates.
    Scores beyond 64 bits are refused. An empty table gives an empty result.

    How: blocks of candidates meet blocks of queries, each pair in one task, which scores
    all by a matrix product and returns a histogram of each query's scores, of which only
    the bins down to its own k-th score matter. Summed over all blocks, they show the bin
    that holds the k-th score; the next round divides that bin, until it is one score
    wide. Last, scores above it are kept, and of those equal to it the k smallest ids of
    each block, so that a vector repeated in a third of all rows adds k rows per block.
    """
    spark = vectors.sparkSession
    checkpoint_root(spark)
    vectors = vectors.withColumn("dim", F.size("vector")).withColumn(
        "row", F.monotonically_increasing_id()).checkpoint()
    n, asked, norm = vectors.agg(
        F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)),
        F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") ** 2))).first()
    bound = math.ceil((norm or 0) * (1 + 1e-9)) + 1  # no score is larger (Cauchy-Schwarz)
    if bound >= 2**62:
        raise ResearchError("inner products may pass 64 bits")
    blocks, chunks = 1 + n // CANDIDATES, 1 + asked // QUERIES
    candidates = vectors.select(
        "row", "vec_id", "vector", "dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1))).alias("chunk"))
    queries = vectors.where(F.col("vec_id") % every == 0).select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"),
        F.col("vector").alias("query"), F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"))
    key = ["block", "chunk", "dim"]

    def scored(state: DataFrame, of, schema: str) -> DataFrame:
        asking = queries.join(state, "query_row").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))))
        return candidates.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(of, schema)

    shift = max((2 * bound).bit_length() - BITS, 0)
    # low: the smallest score of the bin that holds the k-th; need: its rank inside the bin.
    state = queries.select("query_row", F.lit(-bound).cast("long").alias("low"),
                           F.lit(k).cast("long").alias("need"))
    width = None
    while True:
        bins = scored(state, _counting(shift, width, bound),
                      "query_row long, bin long, n long") \
            .groupBy("query_row", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_row").orderBy(F.desc("bin"))
        found = (bins.withColumn("upto", F.sum("n").over(down))
                 .join(state, "query_row").where("upto >= need AND upto - n < need")
                 .select("query_row", (F.col("low") + F.col("bin") * (1 << shift)).alias("low"),
                         (F.col("need") - F.col("upto") + F.col("n")).alias("need")))
        # A query that misses here has fewer than k candidates: all scores are wanted.
        state = (queries.select("query_row").join(found, "query_row", "left")
                 .select("query_row", F.coalesce("low", F.lit(-bound)).cast("long").alias("low"),
                         F.coalesce("need", F.lit(k)).cast("long").alias("need")).checkpoint())
        if shift == 0:
            break
        width, shift = 1 << shift, max(shift - BITS, 0)

    def kept(c: pa.Table, q: pa.Table) -> pa.Table:
        return _kept(c, q, k, bound)

    best = scored(state, kept, "query_row long, vec_id long, score long")
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(queries.select("query_row", "query_id"), "query_row")
            .select("query_id", "rank", "vec_id", "score"))


def _matrix(column: pa.ChunkedArray, bound: int) -> np.ndarray:
    rows = T.one(column)
    flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return flat.astype(np.float64) if bound < 2**52 else flat  # doubles are exact up to 2**53


def _scores(candidates: pa.Table, queries: pa.Table, bound: int):
    """For each query: its row, low, need, and the ids and scores of its candidates, which
    are all rows but its own, by rising id."""
    ids, rows = (T.one(candidates[c]).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
    order = np.lexsort((rows, ids))
    ids, matrix = ids[order], _matrix(candidates["vector"], bound)[order]
    by_row = np.argsort(rows[order])
    rows = rows[order][by_row]
    asked = _matrix(queries["query"], bound)
    names, low, need = (T.one(queries[c]).to_numpy(zero_copy_only=False)
                        for c in ("query_row", "low", "need"))
    for first in range(0, len(names), 256):
        part = (asked[first:first + 256] @ matrix.T).astype(np.int64)
        for i, row in enumerate(part, first):
            at = np.searchsorted(rows, names[i])
            if at < len(rows) and rows[at] == names[i]:
                at = by_row[at]
                yield names[i], low[i], need[i], np.delete(ids, at), np.delete(row, at)
            else:
                yield names[i], low[i], need[i], ids, row


def _counting(shift: int, width: int | None, bound: int):
    def counted(c: pa.Table, q: pa.Table) -> pa.Table:
        return _histogram(c, q, shift, width, bound)
    return counted


def _histogram(candidates: pa.Table, queries: pa.Table, shift: int, width: int | None,
               bound: int) -> pa.Table:
    out: list[tuple] = []
    if candidates.num_rows and queries.num_rows:
        for name, low, need, _, scores in _scores(candidates, queries, bound):
            inside = scores[scores >= low]
            if width is not None:
                inside = inside[inside < low + width]
            if len(inside) > need:  # nothing below the block's own need-th score matters
                floor = np.partition(inside, len(inside) - need)[len(inside) - need]
                inside = inside[(inside - low) >> shift >= (floor - low) >> shift]
            bins, n = np.unique((inside - low) >> shift, return_counts=True)
            out += zip([name] * len(bins), bins.tolist(), n.tolist(), strict=True)
    return _table(out, ["query_row", "bin", "n"])


def _kept(candidates: pa.Table, queries: pa.Table, k: int, bound: int) -> pa.Table:
    out: list[tuple] = []
    if candidates.num_rows and queries.num_rows:
        for name, low, _, ids, scores in _scores(candidates, queries, bound):
            above = np.flatnonzero(scores > low)
            equal = np.flatnonzero(scores == low)[:k]  # ids ascend
            at = np.concatenate([above, equal])
            out += zip([name] * len(at), ids[at].tolist(), scores[at].tolist(), strict=True)
    return _table(out, ["query_row", "vec_id", "score"])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)
