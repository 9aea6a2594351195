"""Removal of word windows that a document with a smaller id also holds."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .copies import HOT, numbered

#: Text of a block, the unit whose windows are hashed and answered together.
BLOCK_BYTES = 4_000_000
#: Windows a task compares at a time, on average.
RANGE_WINDOWS = 2_000_000
LAST = np.iinfo(np.int64).max

_BACK = "block long, range long, repeated binary"


def remove_repeats(docs: DataFrame, window: int = 13, carry: list[str] = ()) -> DataFrame:
    """Remove each word covered by a window of ``window`` consecutive words whose word
    sequence also starts in a document with a smaller ``doc_id``.

    Windows are judged on the input. Returns per row: ``doc_id``, the columns ``carry`` (without
    those named like a result),
    ``text`` (the kept words joined by one space; untouched where nothing was removed),
    ``kept_words`` (the same, always joined), ``n_words``, ``n_removed`` and ``spans`` (the
    maximal runs of removed words, ``[first, last)``). A text that is null, empty or
    shorter than a window keeps all its words (null: none, and ``text`` stays null). A
    null ``doc_id`` counts as larger than all others; rows with equal ids never remove
    each other's words. Other columns of the input are ignored.

    How: documents are dealt into blocks by a hash. Each block hashes every window
    (Rabin-Karp, 64 bits), keeps each hash once with its smallest id, and sends it, sorted
    and packed, to the task of its hash range: about seven bytes a window. There the
    smallest id of each hash over all blocks is found, and one bit per hash goes back: is
    a smaller id elsewhere? A hash found in a third of all documents is one entry per
    block; rows alike in id and text are dealt into several where they are many. Blocks and ranges are as many as the text needs, so no task holds more than a
    few million windows; a single text is never split. Two different windows are taken
    for equal with probability 2**-64 per pair.
    """
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + text_bytes // BLOCK_BYTES
    ranges = 1 + text_bytes // (6 * RANGE_WINDOWS)  # a word and its space take six bytes
    carry = [c for c in carry if c not in (
        "doc_id", "text", "kept_words", "n_words", "n_removed", "spans")]
    laid = numbered(docs.select(F.col("doc_id").cast("long"), "text", *carry).withColumn(
        "_same", F.xxhash64("doc_id", "text")), "_same")
    laid = laid.withColumn("_block", F.pmod(
        F.xxhash64("_same", F.floor(F.col("_copy") / HOT)), F.lit(blocks))).drop("_same", "_copy")

    def spread(table: pa.Table) -> pa.Table:
        try:
            return _sent(table, window, ranges)
        finally:
            T.trim()

    def answer(table: pa.Table) -> pa.Table:
        return _met(table)

    def cut(rows: pa.Table, back: pa.Table) -> pa.Table:
        try:
            return _cut(rows, back, window, ranges, carry)
        finally:
            T.trim()

    sent = laid.groupBy("_block").applyInArrow(
        spread, "block long, range long, hashes binary, ids binary, owners binary")
    back = sent.groupBy("range").applyInArrow(answer, _BACK)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema
                     if f.name in carry)
    return laid.groupBy("_block").cogroup(back.groupBy("block")).applyInArrow(
        cut, "doc_id long, text string, kept_words string, n_words long, n_removed long, "
             "spans array<array<int>>" + (", " + kept if kept else ""))


class _Block:
    """Distinct window hashes of a block in order, each with its smallest id."""

    def __init__(self, table: pa.Table, window: int):
        ids = table["doc_id"].combine_chunks().fill_null(LAST)
        self.words = T.words(table["text"])
        self.at = T.whole(self.words.offsets, window)
        hashes = T.rolling(self.words.hashes(), window)[self.at]
        ids = T.one(ids).to_numpy(zero_copy_only=False)
        self.order = np.argsort(hashes)
        self.ids = ids[self.words.owner()[self.at]][self.order]
        hashes = hashes[self.order]
        self.new = np.ones(len(hashes), bool)
        self.new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(self.new)
        self.hashes = hashes[first]
        self.least = np.minimum.reduceat(self.ids, first) if len(first) else self.ids

    def cuts(self, ranges: int) -> np.ndarray:
        """Where each hash range starts in the ordered hashes."""
        width = -(-2**64 // ranges)
        bounds = np.array([i * width for i in range(1, ranges)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.hashes, bounds), [len(self.hashes)]])


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed: the leading ones are mostly zero."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8")


def _sent(table: pa.Table, window: int, ranges: int) -> pa.Table:
    block = _Block(table, window)
    cuts, rows = block.cuts(ranges), []
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            ids, owner = np.unique(block.least[a:b], return_inverse=True)
            rows.append((table["_block"][0].as_py(), r,
                         _packed(np.diff(block.hashes[a:b], prepend=np.uint64(0))),
                         ids.tobytes(), _packed(owner)))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = {"block": pa.int64(), "range": pa.int64(), "hashes": pa.binary(),
             "ids": pa.binary(), "owners": pa.binary()}
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)],
                    names=list(kinds))


def _met(table: pa.Table) -> pa.Table:
    """Per entry of each block: does a smaller id hold the same hash elsewhere?"""
    hashes = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table["hashes"].to_pylist()]
    least = [np.frombuffer(i, np.int64)[_unpacked(o)] for i, o in zip(
        table["ids"].to_pylist(), table["owners"].to_pylist(), strict=True)]
    every, own = np.concatenate(hashes), np.concatenate(least)
    order = np.argsort(every)
    every, own = every[order], own[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    lowest = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    flags = np.empty(len(order), bool)
    flags[order] = lowest < own
    bits = [np.packbits(f).tobytes() if f.any() else None for f in np.split(
        flags, np.cumsum([len(h) for h in hashes])[:-1])]
    return pa.table({"block": table["block"], "range": table["range"],
                     "repeated": pa.array(bits, pa.binary())}).filter(
                         pc.is_valid(pa.array(bits, pa.binary())))


def _cut(rows: pa.Table, back: pa.Table, window: int, ranges: int,
         carry: list[str]) -> pa.Table:
    block = _Block(rows, window)
    words, cuts = block.words, block.cuts(ranges)
    elsewhere = np.zeros(len(block.hashes), bool)
    for r, bits in zip(back["range"].to_pylist(), back["repeated"].to_pylist(), strict=True):
        a, b = cuts[r], cuts[r + 1]
        elsewhere[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    entry = np.cumsum(block.new) - 1
    again = np.empty(len(entry), bool)
    again[block.order] = elsewhere[entry] | (block.least[entry] < block.ids)
    removed = T.covered(block.at[again], window, len(words.codes))
    n_removed = words.per_text(removed)
    kept_at = np.concatenate([[0], np.cumsum(words.counts - n_removed)])
    flat = words.flat.filter(pa.array(~removed)) if n_removed.any() else words.flat
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), flat), " ")
    text = T.one(rows["text"])
    out = {"doc_id": T.one(rows["doc_id"]),
           "text": pc.if_else(pa.array(n_removed == 0), text, kept), "kept_words": kept,
           "n_words": pa.array(words.counts, pa.int64()),
           "n_removed": pa.array(n_removed, pa.int64()), "spans": _spans(words, removed)}
    return pa.table(out | {c: T.one(rows[c]) for c in carry if c not in out})


def _spans(words: T.Words, removed: np.ndarray) -> pa.Array:
    """Maximal runs of removed words, by text, counted from its first word."""
    owner = words.owner()
    before = np.zeros(len(removed), bool)
    before[1:] = removed[:-1] & (owner[1:] == owner[:-1])
    after = np.zeros(len(removed), bool)
    after[:-1] = removed[1:] & (owner[1:] == owner[:-1])
    first, last = np.flatnonzero(removed & ~before), np.flatnonzero(removed & ~after)
    base = words.offsets[owner[first]]
    pairs = np.stack([first - base, last + 1 - base], 1).reshape(-1)
    runs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, 2), pa.int32()),
                                    pa.array(pairs, pa.int32()))
    per_text = np.bincount(owner[first], minlength=len(words.offsets) - 1)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), runs)
