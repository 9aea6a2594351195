"""Token ids of a corpus in Huffman-coded files, and back."""
from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ResearchError
from ..session import discard, scratch_path
from . import text as T
from .huffman import Code, code_lengths

#: A block closes with the document that brings it to this many ids.
BLOCK_IDS = 1 << 16
#: The id after each document.
END = 1
#: Within these letters case and composition are the same for every Unicode version.
_LETTERS = "a-zß-öø-įĲ-ſ"
PLAIN = "^[!-~À-ÖØ-öø-įĲ-ſ]+$"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|\n|[^\n0-9{_LETTERS}]+").findall
#: How tokenizers whose words never meet cut text (a fixed value): nothing crosses white space.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BLOCK = ("part int, block int, first long, n_ids long, doc_ids array<long>, "
          "doc_tokens array<long>, payload binary, checkpoints binary")


def write_ids(docs: DataFrame, tokenizer: str, path: str, max_bits: int = 16) -> None:
    """Tokenise documents and write their ids under ``path``, in ascending ``doc_id`` order.

    ``tokenizer`` is the path of a tokenizer file, the same on every machine. A document
    is its ids without special ones, then the id 1; a null or empty text is that id alone.
    Null ids come first; rows of one id go by a hash of their ids; repeated rows are each
    written. Other columns are ignored. An empty table gives an empty pair of tables.

    The format is two Parquet tables. ``codes`` (``id``, ``bits``, ``n``) is the code book:
    a canonical Huffman code from the counts of all ids, no code over ``max_bits`` (or what
    the number of ids needs). ``blocks`` has a row for each run of whole documents of at
    least ``BLOCK_IDS`` ids: its ``part`` (parts follow one another) and number ``block``
    there, the part's ids before it (``first``), ``n_ids``, the ``doc_ids`` and
    ``doc_tokens`` of its documents, the ``payload`` of codes, and ``checkpoints``: the bits
    of every 64 ids. A block needs no other to be decoded.

    How: documents are encoded in one scan and written, counted per task, ranged by id and
    coded. What reaches the driver is a count per id of the vocabulary. A task holds a
    slice of text or one block; a document's ids are never divided.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer
    symbols = Tokenizer.from_file(tokenizer).get_vocab_size() + 1
    kind = "<u2" if symbols <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        coder = words_coder(tokenizer)
        for part in T.slices(batches):
            flat, offsets = coder.encode(T.one(part["text"]), END)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([
                T.one(part["doc_id"]), pa.array(np.arange(row, row + n)),
                pa.array(np.diff(offsets)), binary(flat.astype(kind), offsets)],
                names=["doc_id", "row", "n", "ids"])
            row += n

    held = scratch_path(spark, "ids")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        T.tidy(encode), "doc_id long, row long, n long, ids binary").write.parquet(held)
    encoded = spark.read.parquet(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            total += np.bincount(numbers(batch.column("ids"), kind), minlength=symbols)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = (encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id")
              .agg(F.sum("n").alias("n")).orderBy("id").toArrow())  # a row per id of the vocabulary
    ids, n = (T.one(counts[c]).to_numpy() for c in ("id", "n"))
    bits = code_lengths(n, max(max_bits, (max(len(ids), 1) - 1).bit_length()))
    code = Code(ids, bits)
    spark.createDataFrame(pa.table({"id": ids, "bits": bits.astype(np.int32), "n": n})) \
        .coalesce(1).write.parquet(f"{path}/codes")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        names, sizes, held, size = [], [], [], 0

        def closed():
            payload, checkpoints = code.encode(np.concatenate(held))
            return pa.RecordBatch.from_pylist([dict(
                part=part, block=block, first=first, n_ids=size, doc_ids=names,
                doc_tokens=sizes, payload=payload, checkpoints=checkpoints)], schema=schema)

        for rows in T.slices(batches, "ids"):
            flat = numbers(T.one(rows["ids"]), kind)
            ends = np.cumsum(T.one(rows["n"]).to_numpy())
            for doc_id, begin, end in zip(rows["doc_id"].to_pylist(), [0, *ends[:-1]], ends,
                                          strict=True):
                names.append(doc_id)
                sizes.append(int(end - begin))
                held.append(flat[begin:end].copy())
                size += int(end - begin)
                if size >= BLOCK_IDS:
                    yield closed()
                    block, first = block + 1, first + size
                    names, sizes, held, size = [], [], [], 0
        if names:
            yield closed()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()),
                        ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary()),
                        ("checkpoints", pa.binary())])
    keys = ["doc_id", "_hash", "row"]
    (encoded.withColumn("_hash", F.xxhash64("ids")).repartitionByRange(*keys)
     .sortWithinPartitions(*keys).select("doc_id", "n", "ids")
     .mapInArrow(T.tidy(compress), _BLOCK).write.parquet(f"{path}/blocks"))
    discard(spark, held)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files under ``path``: ``doc_id``, ``start`` (ids of all documents
    before), ``n_tokens`` (with the end id), ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit numbers), and with ``with_ids`` the ``ids``. A block that does not
    decode to its checkpoints is refused. The code book, at most a row per id of the
    vocabulary, is read by the driver."""
    book = spark.read.parquet(f"{path}/codes").toArrow()
    code = Code(*(T.one(book[c]).to_numpy(zero_copy_only=False) for c in ("id", "bits")))
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "payload"):
            for row in part.to_pylist():
                ids = code.decode(row["payload"], row["checkpoints"], row["n_ids"])
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                if len(ends) == 0 or ends[-1] != len(ids):
                    raise ResearchError("a block's documents do not fill it")
                data = memoryview(ids.astype("<u4")).cast("B")
                check = [zlib.crc32(data[4 * (e - s):4 * e]) for s, e in zip(sizes, ends, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()),
                           pa.array(np.full(len(ends), row["part"], np.int32)),
                           pa.array(row["first"] + ends - sizes), pa.array(sizes),
                           pa.array(check, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ("doc_id long, part int, inside long, n_tokens long, ids_crc32 long"
              + (", ids array<int>" if with_ids else ""))
    names = [f.split()[0] for f in fields.split(", ")]
    ahead = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = (blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per writing task
             .select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before")))
    return blocks.mapInArrow(T.tidy(decode), fields).join(parts, "part").select(
        "doc_id", (F.col("_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of an array as binary values; run ``i`` is ``offsets[i]:offsets[i+1]``."""
    data = pa.py_buffer(np.ascontiguousarray(values))
    at = (offsets * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(at), data]).cast(pa.binary())


def numbers(column: pa.Array, kind: str) -> np.ndarray:
    """All numbers of a binary column, one row after another."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, kind)
    at = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind)


# --- ids ----------------------------------------------------------------------------------

_CODERS: dict[str, WordsCoder] = {}


def words_coder(path: str) -> WordsCoder:
    """One per process and file: its memory of words serves all tasks of a worker."""
    return _CODERS.get(path) or _CODERS.setdefault(path, WordsCoder(path))


class WordsCoder:
    """Ids by a tokenizer file. Where its rules show that no token crosses white space,
    each distinct word is encoded once and remembered, up to ``KEPT`` characters in all;
    otherwise whole texts are encoded. Words of letters and signs whose lower case and
    composition are beyond doubt (``PLAIN``) are cut here into the pieces that the
    tokenizer would merge alone, and only distinct pieces reach it."""

    KEPT = 10_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _words_only(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.closing = _closing(spec) if self.by_word else None
        if self.closing is not None:
            from tokenizers import normalizers, pre_tokenizers
            self.merger = Tokenizer.from_file(path)
            self.merger.encode_special_tokens = True
            self.merger.normalizer = normalizers.Sequence([])
            self.merger.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split("\n", "removed"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {"\n": 0}
        self.chars = 0
        self.words, self.merged = T.Runs(np.uint32), T.Runs(np.uint32)
        self.merged.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))  # a line's end has no ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each text's followed by ``end``, and where each text starts."""
        texts = pc.fill_null(T.one(texts).cast(pa.string()), "")
        if not self.by_word:
            found = [np.array([*x.ids, end], np.uint32) for x in
                     self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return (np.concatenate([np.zeros(0, np.uint32), *found]),
                    np.cumsum([0, *map(len, found)], dtype=np.int64))
        words = T.words(texts)
        codes = self._codes(words.vocabulary)[words.codes] if len(words.codes) \
            else np.zeros(0, np.int64)
        ids, sizes = self.words.take(codes)
        offsets = np.concatenate([[0], np.cumsum(words.per_text(sizes) + 1)]).astype(np.int64)
        out = np.full(int(offsets[-1]), end, np.uint32)
        place = np.ones(len(out), bool)
        place[offsets[1:] - 1] = False
        out[place] = ids
        return out, offsets

    def _codes(self, vocabulary: pa.Array) -> np.ndarray:
        if self.chars > self.KEPT:
            self._forget()
        codes = _looked_up(self.known, _strings(vocabulary))
        new = np.flatnonzero(codes < 0)
        if len(new):
            words = vocabulary.take(pa.array(new))
            plain = np.zeros(len(new), bool)
            if self.closing is not None:
                plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
                for s in self.special:
                    plain = plain & ~pc.match_substring(words, s).to_numpy(zero_copy_only=False)
            parts = [_strings(words.filter(pa.array(mask))) for mask in (plain, ~plain)]
            self._learn_plain(parts[0])
            found = [x.ids for x in self.tokenizer.encode_batch_fast(parts[1], add_special_tokens=False)]
            self.words.add(np.array([i for f in found for i in f], np.uint32),
                           np.array([len(f) for f in found], np.int64))
            first = len(self.known)
            for part in parts:
                self.known.update(zip(part, range(len(self.known), len(self.known) + len(part)),
                                      strict=True))
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            codes[new[order]] = np.arange(first, first + len(new))
            self.chars += pc.sum(pc.utf8_length(words)).as_py() + 8 * len(new)
        return codes

    def _learn_plain(self, words: list[str]) -> None:
        if not words:
            return
        found = PIECES("\n".join(words).lower())
        codes = _looked_up(self.pieces, found)
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            new = list(dict.fromkeys(found[i] for i in missing))
            for first in range(0, len(new), 1000):
                ids = np.array(self.merger.encode_batch_fast(
                    ["\n".join(new[first:first + 1000])], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.closing[ids]) + 1  # each piece's last token says so
                self.merged.add(ids, np.diff(ends, prepend=0))
            self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new)), strict=True))
            self.chars += sum(map(len, new)) + 8 * len(new)
            codes[missing] = _looked_up(self.pieces, [found[i] for i in missing])
        ids, sizes = self.merged.take(codes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        lines = np.concatenate([np.flatnonzero(codes == 0), [len(codes)]])
        self.words.add(ids, np.diff(upto[lines], prepend=0))


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def _looked_up(known: dict[str, int], keys: list[str]) -> np.ndarray:
    return np.fromiter(map(known.get, keys, itertools.repeat(-1)), np.int64, len(keys))


def _closing(spec: dict) -> np.ndarray | None:
    """Which ids end a piece, where every piece's last token is marked as such."""
    model = spec["model"]
    mark, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
    own = [c for c in vocabulary if len(c) == 1]
    if model["type"] != "BPE" or not mark or len(own) < 256 or any(c + mark not in vocabulary for c in own):
        return None
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
    return out


def _words_only(spec: dict) -> bool:
    """Whether each word between white space is encoded by itself, whatever stands near."""
    steps = spec.get("normalizer") or {}
    steps = steps.get("normalizers", [steps] if steps else [])
    harmless = all(s["type"] in ("NFC", "Lowercase") or s == {
        "type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for s in steps)
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = cut[0]
    apart = (first.get("type") == "Split" and first.get("pattern") == {"Regex": WORDS_ONLY}
             and first.get("behavior") == "Removed" and first.get("invert") is True)
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                     or t.get("normalized")) and not any(c.isspace() for c in t["content"])
                for t in spec.get("added_tokens", []))
    return bool(harmless and apart and plain and spec.get("post_processor") is None
                and spec.get("truncation") is None)
