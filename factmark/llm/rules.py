"""Repetition coverage: how much of a text lies in repeated word n-grams and lines."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Share of a text's word characters that may lie in repeated n-grams, by n.
LIMITS = {5: 0.20, 6: 0.19, 8: 0.18, 10: 0.17}
#: Share of word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.20


def repetition_coverage(docs: DataFrame, limits: dict[int, float] = LIMITS,
                        line_limit: float = LINE_LIMIT) -> DataFrame:
    """Measure repetition in every whole text and judge it.

    Returns one row per input row: ``doc_id``; ``n_words``; ``word_chars`` (code points in
    words); ``n_symbols`` (characters of ``[#*$%&|<>]``); ``n_dup_lines`` (lines with a
    word that equal an earlier line); ``n_repeat_words`` (words in five-word windows found
    twice or more); ``dup_line_chars`` and ``dup_chars_<n>`` (code points of words inside
    repeated lines, or inside n-grams found twice or more, the first included);
    ``base_failed``; ``kept`` (false if the base rules fail or a share passes its limit).

    A null, empty or blank text has zeros everywhere and fails the base rules (fewer than
    ten words). Rows are judged alone, so repeated rows, null ids and ties change nothing;
    columns other than ``doc_id`` and ``text`` are ignored. One task holds a slice of
    ``text.SLICE_BYTES`` or one longer text at a time; nothing is shuffled.
    """
    ns = sorted(limits)
    fields = ["doc_id long", *(f"{c} long" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "dup_line_chars", *(f"dup_chars_{n}" for n in ns)))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            yield _measured(part, ns)

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        measure, ", ".join(fields))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    for n in ns:
        fine &= F.col(f"dup_chars_{n}") <= limits[n] * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def _measured(part: pa.Table, ns: list[int]) -> pa.RecordBatch:
    texts = pc.fill_null(T.one(part["text"]), "")
    w = T.words(texts)
    size = len(w.codes)
    chars = pc.utf8_length(w.vocabulary).to_numpy(zero_copy_only=False)[w.codes] if size else \
        np.zeros(0, np.int64)
    salt = T.mixed(np.arange(1, len(texts) + 1, dtype=np.uint64))[w.owner()]
    hashes = w.hashes()
    columns = [w.counts, w.per_text(chars),
               pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)]
    masks = {n: _repeated(w, hashes, salt, n) for n in {5, *ns}}
    lines, line_chars = _lines(texts)
    columns += [lines, w.per_text(masks[5]), line_chars]
    columns += [w.per_text(masks[n] * chars) for n in ns]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "dup_line_chars", *(f"dup_chars_{n}" for n in ns)]
    return pa.RecordBatch.from_arrays(
        [T.one(part["doc_id"]), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])


def _repeated(w: T.Words, hashes: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """Words inside n-grams that their own text holds twice or more."""
    at = T.whole(w.offsets, n)
    keys = T.rolling(hashes, n)[at] ^ salt[at]
    return T.covered(at[T.twice(keys)], n, len(hashes))


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text: how many, and the
    code points of their words."""
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)),
                      pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(T.one(lists.flatten()))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = T.words(coded.dictionary)
    chars = distinct.per_text(
        pc.utf8_length(distinct.vocabulary).to_numpy(zero_copy_only=False)[distinct.codes]
        if len(distinct.codes) else np.zeros(0, np.int64))
    key = owner * max(len(coded.dictionary), 1) + codes
    later = np.ones(len(key), bool)
    later[np.unique(key, return_index=True)[1]] = False
    later &= chars[codes] > 0
    return (np.bincount(owner[later], minlength=len(texts)),
            np.bincount(owner[later], chars[codes][later], minlength=len(texts)).astype(np.int64))
