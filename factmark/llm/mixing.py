"""Mixing sources to target weights by apportioned blocks of words."""
from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .copies import HOT, numbered

#: Words of a block.
BLOCK = 16
#: Documents of a source laid out in one task, on average.
LAID_OUT = 8_000
_OWN = ("doc_id", "size", "source_size", "target", "taken", "first_word", "rounds", "extra",
        "blocks", "start")
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of all words by weight; what passes ``most`` times a source's size goes to
    the others by weight, until none is above."""
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        for i in above or free:
            out[i] = float(most * sizes[i]) if above else left * weights[i] / weight
        if not above:
            break
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free or i in above)
        free -= above
    return out


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Lague: each seat to the highest ``votes / (2 * seats so far + 1)``, nobody
    above ``most``; equal quotients go to the lower index. All seats but the last few
    follow from a divisor, the same as giving them one by one."""
    votes = np.asarray(votes, float)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), most).astype(np.int64)

    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    high = 4 * votes.max() + 1.0  # gives none
    low = high
    while given(low).sum() <= seats and low > 1e-12:
        low /= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() > seats else (low, middle)
    out = given(high * (1 + 1e-9))  # a hair wider, so that equal quotients are left over
    heap = [(-votes[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(out < most)]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
        seed: int = 17, carry: list[str] = ()) -> DataFrame:
    """Choose how many words of each document a mix of its size takes.

    A document's size is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).
    Sources by code point, null last, weigh ``weights`` in turn and share all words; none
    gets more than ``most`` times its words, the excess going to the others by weight.
    Returns per row ``doc_id``, ``size``, ``source_size``, ``target`` (its source's),
    ``taken`` (words taken, repeats counted, at most ``most * size``), the columns
    ``carry`` (without those named like a result), and the place of the row's words in its shard: ``first_word``, ``rounds``
    (times the whole shard is taken), ``extra``, ``blocks``, ``start``, from which
    ``chosen`` tells whether a block is taken once more.

    Rows without words take nothing; a source without words has the target 0. Null ids
    and repeated rows are rows like any other; of a row that repeats more than HOT times the
    copies are dealt out by number. The same rows give the same result however they are
    partitioned. An empty table gives an empty result.

    How: a source's documents are dealt into shards by a seeded hash, laid end to end in
    a seeded order inside each shard, and cut into blocks of BLOCK words. Sainte-Lague
    gives each source its blocks and each of its shards an integer quota. A shard's quota
    is so many whole rounds, and for the rest one run of blocks from a seeded start, which
    wraps round: documents are taken whole or not at all, but for those at its two ends.
    Only sums by source and by shard reach the driver: a row per source, whose number is
    taken to be small, and per LAID_OUT documents, so it grows with the table by one row in
    8,000. A source with a third of all rows has as many shards as it needs; a document's words
    are never exploded, its share follows from where its first and last word lie.
    """
    spark = docs.sparkSession
    carry = [c for c in carry if c not in _OWN]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *carry,
        *([] if "source" in carry else ["source"]),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_order"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = numbered(rows, "_order").withColumn("_order", F.when(
        F.col("_copy") < HOT, F.col("_order")).otherwise(
            F.xxhash64("_order", F.floor(F.col("_copy") / HOT)))).drop("_copy")
    sums = [(r.source, int(r.words), int(r.n)) for r in rows.groupBy("source").agg(
        F.sum("size").alias("words"), F.count("*").alias("n")).collect()]
    sums.sort(key=lambda r: (r[0] is None, r[0] or ""))
    target = targets([w for _, w, _ in sums], [weights[i % len(weights)] for i in range(len(sums))],
                     most)
    sources = spark.createDataFrame(pd.DataFrame(
        [(s, i, w, target[i], 1 + n // LAID_OUT) for i, (s, w, n) in enumerate(sums)],
        columns=["_source", "_index", "source_size", "target", "_shards"]),
        "_source string, _index int, source_size long, target double, _shards long")
    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_shard", F.pmod("_order", "_shards")).drop("_source", "_shards")
    if "source" not in carry:
        dealt = dealt.drop("source")
    shards = dealt.groupBy("_index", "_shard").agg(F.sum("size").alias("words")) \
        .toPandas().sort_values(["_index", "_shard"]).reset_index(drop=True)
    quotas = spark.createDataFrame(
        _quotas(shards, [w for _, w, _ in sums], target, most, seed),
        "_index int, _shard long, rounds long, extra long, blocks long, start long")
    line = W.partitionBy("_index", "_shard").orderBy("_order", "doc_id", "size")
    laid = dealt.withColumn("first_word", F.sum("size").over(
        line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    taken = laid.join(quotas, ["_index", "_shard"]).withColumn(
        "taken", F.col("rounds") * F.col("size")
        + _words_before(F.col("first_word") + F.col("size")) - _words_before(F.col("first_word")))
    return taken.drop("_index", "_shard", "_order")


def _quotas(shards: pd.DataFrame, sizes: list[int], target: list[float], most: int,
            seed: int) -> pd.DataFrame:
    """Whole rounds and extra blocks of every shard."""
    shards = shards.assign(blocks=-(-shards["words"].astype("int64") // BLOCK))
    own = shards.groupby("_index")["blocks"].sum().reindex(range(len(sizes)), fill_value=0)
    own = own.to_numpy(np.int64)
    votes = np.array([t / s * b if s else 0.0 for t, s, b in zip(target, sizes, own, strict=True)])
    by_source = apportion(votes, round(float(votes.sum())), most * own)
    quota = np.zeros(len(shards), np.int64)
    for i, at in shards.groupby("_index").groups.items():
        blocks = shards.loc[at, "blocks"].to_numpy(np.int64)
        quota[at] = apportion(blocks, by_source[i], most * blocks)
    blocks = np.maximum(shards["blocks"].to_numpy(np.int64), 1)
    start = [zlib.crc32(f"{seed} {i} {s}".encode()) % b for i, s, b in zip(
        shards["_index"], shards["_shard"], blocks, strict=True)]
    return pd.DataFrame({"_index": shards["_index"], "_shard": shards["_shard"],
                         "rounds": quota // blocks, "extra": quota % blocks,
                         "blocks": blocks, "start": start})


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of non-negative integers."""
    return ((x - F.pmod(x, y)) / y).cast("long")


def _chosen_before(block: Column) -> Column:
    """How many of a shard's blocks before this one are taken once more: they are one run
    from the seeded start, which goes on at the shard's first block after its last."""
    end = F.col("start") + F.col("extra")
    return (F.least(F.greatest(block - F.col("start"), F.lit(0)), F.col("extra"))
            + F.greatest(F.least(block, end - F.col("blocks")), F.lit(0)))


def chosen(word: Column) -> Column:
    """1 if the block of this word of the shard is taken once more, else 0."""
    block = _div(word, F.lit(BLOCK))
    return _chosen_before(block + 1) - _chosen_before(block)


def _words_before(word: Column) -> Column:
    """Words taken once more among the shard's words before this one."""
    return (BLOCK * _chosen_before(_div(word, F.lit(BLOCK)))
            + chosen(word) * F.pmod(word, F.lit(BLOCK)))


def mixed_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
                 seed: int = 17) -> DataFrame:
    """The mix itself, with the columns ``doc_id, text, lang, source, n_chars``: a document
    once for each whole round, and once more if it lies in its shard's run of extra blocks,
    with its whole text. A document at an end of the run gives the words inside, which
    follow each other in it, joined by spaces; one that holds both ends may give two such
    rows, never one with words from either side of a gap. Copies share their ``doc_id``."""
    rows = mix(docs, weights, most, seed, carry=["text", "lang", "source"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    more = F.col("taken") - F.col("rounds") * F.col("size")
    # The run, and what of it goes on at the front, as words of the document, [first, end).
    end = F.col("start") + F.col("extra")
    first = F.greatest(BLOCK * F.col("start") - F.col("first_word"), F.lit(0))
    last = F.least(BLOCK * F.least(end, F.col("blocks")) - F.col("first_word"), F.col("size"))
    front = F.least(BLOCK * (end - F.col("blocks")) - F.col("first_word"), F.col("size"))

    def piece(begin: Column, stop: Column) -> Column:
        return F.when(stop > begin, F.array_join(
            F.slice(words, (begin + 1).cast("int"), (stop - begin).cast("int")), " "))

    extra = F.when(more == F.col("size"), F.array("text")).when(more > 0, F.array_compact(F.array(
        piece(F.lit(0).cast("long"), front), piece(first, last)))).otherwise(F.array().cast("array<string>"))
    return (rows.where((F.col("size") > 0) & (F.col("taken") > 0))
            .select("doc_id", "lang", "source", F.explode(F.concat(
                F.array_repeat("text", F.col("rounds").cast("int")), extra)).alias("text"))
            .select("doc_id", "text", "lang", "source")
            .withColumn("n_chars", F.length("text").cast("long")))
