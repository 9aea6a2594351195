"""Whitened principal components of embeddings, exact up to the last step."""
from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ResearchError
from ..session import discard, scratch_path
from . import spectrum
from . import text as T

_OUT = ("vec_id long, component int, deviation long, deviation_exact decimal(38,0), "
        "whitened double, explained double")


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64) -> DataFrame:
    """Project integer vectors on the unit eigenvectors of their covariance, to variance 1.

    ``vectors`` has ``vec_id`` and ``embedding``. Rows whose vector is null, empty, or holds
    a null or non-finite entry are left out, and so are those not of the commonest length
    (of equally common ones the longest); other columns are ignored. An entry c becomes
    ``floor(scale * c)``; a constant added to all (the usual 1,000,000) changes no result
    and is left out. Entries of 2**52 and more after scaling are refused. The fit list holds
    each distinct vector once: n vectors with sums S.

    Returns a row for each vector and component: ``vec_id``, ``component`` (from 1, by
    falling eigenvalue), ``n``, ``deviation`` (sum over dimensions of (n x - S)^2; null
    where it passes 63 bits), ``deviation_exact`` (the same in 38 digits), ``whitened``,
    ``explained`` (the eigenvalue's share of the trace) and ``identity_error`` (the largest
    entry, without sign, of the covariance of ``whitened`` over the fit list minus the
    identity). Only components with a positive eigenvalue exist, so vectors without
    differences, or an empty table, give no rows. Null ids and repeated rows are rows like
    any other, and repeated vectors weigh once in the fit. Where eigenvalues are equal any
    basis of their space may come out. A component's largest entry is positive.

    How: tasks sum products of integers exactly; the scatter n * sum(x x') - S S', of as
    many entries as dimensions squared, reaches the driver. Its characteristic polynomial is
    taken modulo many primes, one prime a row of a Spark job, and joined by Chinese
    remainders; sign changes isolate its largest roots; for each, another job's task
    iterates in its null space with long fixed-point numbers.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce((F.size(x) > 0) & sound, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"),
        F.size(x).alias("_size"))
    common = (rows.groupBy("_size").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))).alias("top"))
        .orderBy(F.desc("n"), F.desc("_size")).limit(1).collect())
    if not common:
        return _nothing(vectors)
    d, largest = common[0]["_size"], common[0]["top"] * scale + 1
    if largest >= 2**52:
        raise ResearchError("entries of 2**52 and more cannot be whitened exactly")
    kind = "int" if largest < 2**31 else "long"
    rows = rows.where(F.col("_size") == d).select("vec_id", F.transform(
        "embedding", lambda v: F.floor(v.cast("double") * scale).cast(kind)).alias("x"))
    held = scratch_path(spark, "fit-list")
    rows.select("x").distinct().write.parquet(held)
    fit = spark.read.parquet(held)
    upper = np.triu_indices(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row (i, j): sum of x_i x_j; row (-1, j): of x_j; row (-1, -1): how many."""
        n, total, products = 0, np.zeros(d, object), np.zeros(len(upper[0]), object)
        step = max(int(2**53 // largest**2), 1)  # sums of so many products are exact doubles
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            total += x.sum(axis=0)
            for first in range(0, len(x), step):
                part = x[first:first + step]
                part = part.astype(np.float64 if largest**2 < 2**53 else object)
                square = (part.T @ part)[upper]
                products += square.astype(np.int64) if square.dtype != object else square
        if n:
            numbers = [n, *total.tolist(), *products.tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([[-1], np.full(d, -1), upper[0]]).astype(np.int32)),
                pa.array(np.concatenate([[-1], np.arange(d), upper[1]]).astype(np.int32)),
                pa.array([Decimal(int(v)) for v in numbers], pa.decimal128(38, 0))],
                names=["i", "j", "value"])

    cells = (fit.mapInArrow(sums, "i int, j int, value decimal(38,0)").groupBy("i", "j")
             .agg(F.sum("value").cast("decimal(38,0)").alias("value")).toArrow())  # dimensions squared
    value = {(i, j): int(v) for i, j, v in zip(*(cells[c].to_pylist() for c in ("i", "j", "value")),
                                               strict=True)}
    n, s = value[-1, -1], np.array([value[-1, j] for j in range(d)], object)
    scatter = np.zeros((d, d), object)
    for i, j in zip(*upper, strict=True):
        scatter[i, j] = scatter[j, i] = n * value[i, j] - s[i] * s[j]
    part = math.gcd(*(int(v) for v in scatter.ravel()))
    if not part:
        discard(spark, held)
        return _nothing(vectors)
    scatter //= part
    roots = _roots(spark, scatter, components)
    basis = _basis(spark, scatter, roots)[:components]
    trace = int(np.trace(scatter))
    repeated = [r for r, count in roots for _ in range(count)][:components]
    explained = np.array([float(r / trace) for r in repeated])
    spread = np.array([math.sqrt(r * part / n**2) for r in repeated])
    k, mean = len(basis), np.array([float(Fraction(int(v), n)) for v in s])

    def projected(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ basis.T / spread

    def spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = projected(_matrix(batch.column("x"), d))
            total += w.T @ w
        at = np.indices((k, k)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())],
                                         names=["i", "j", "value"])

    apart = (F.sum("value") / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    error = (fit.mapInArrow(spreads, "i int, j int, value double").groupBy("i", "j")
             .agg(F.abs(apart).alias("e")).agg(F.max("e")).first()[0])
    discard(spark, held)
    shift = s.astype(object)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            far = _deviations(x, n, shift)
            long = [v if v < 2**63 else None for v in far]
            exact = [Decimal(v) if v < 10**38 else None for v in far]
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(long, pa.int64()).take(pa.array(at)),
                pa.array(exact, pa.decimal128(38, 0)).take(pa.array(at)),
                pa.array(projected(x).ravel()), pa.array(np.tile(explained, len(x)))], names=names)

    names = [f.split()[0] for f in _OUT.split(", ")]
    return rows.mapInArrow(apply, _OUT).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(float(error)).alias("identity_error"), "deviation_exact")


def _nothing(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame(
        [], "vec_id long, component int, n long, deviation long, whitened double, "
            "explained double, identity_error double, deviation_exact decimal(38,0)")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return T.one(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int]:
    """Sum of (n x - S)^2 of each row, as whole numbers."""
    reach = n * int(np.abs(x).max(initial=0)) + max(abs(int(v)) for v in s)
    if reach < 2**62:
        far = n * x - s.astype(np.int64)
        high, low = far >> 26, far & (2**26 - 1)
        if reach >> 26 < 2**26 and x.shape[1] < 2**10:
            a, b, c = ((u * v).sum(axis=1).tolist() for u, v in ((high, high), (high, low), (low, low)))
            return [(p << 52) + (q << 27) + r for p, q, r in zip(a, b, c, strict=True)]
    far = n * x.astype(object) - s
    return [int(v) for v in (far * far).sum(axis=1)]


def _roots(spark, scatter: np.ndarray, k: int) -> list[tuple[Fraction, int]]:
    primes = spectrum.primes_for(scatter)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            found = [spectrum.polynomial_mod(scatter, primes[i]).tolist() for i in at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))],
                                             names=["id", "poly"])

    tasks = min(len(primes), max(spark.sparkContext.defaultParallelism, 1))
    found = (spark.range(0, len(primes), 1, tasks).mapInArrow(images, "id long, poly array<long>")
             .toArrow().sort_by("id"))  # primes x dimensions
    return spectrum.largest_roots(
        spectrum.joined(primes, [np.array(p, np.int64) for p in found["poly"].to_pylist()]), k)


def _basis(spark, scatter: np.ndarray, roots: list[tuple[Fraction, int]]) -> np.ndarray:
    """A unit vector per root, one row each."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                vectors = spectrum.eigenvectors(scatter, *roots[i])
                yield pa.RecordBatch.from_arrays([
                    pa.array([i] * len(vectors), pa.int64()), pa.array(list(range(len(vectors))), pa.int32()),
                    pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["id", "part", "vector"])

    found = (spark.range(0, len(roots), 1, len(roots))
             .mapInArrow(solve, "id long, part int, vector array<double>")
             .toArrow().sort_by([("id", "ascending"), ("part", "ascending")]))  # components x dimensions
    return np.array(found["vector"].to_pylist())
