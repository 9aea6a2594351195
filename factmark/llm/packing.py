"""Sum-of-squares packing of tokenised documents into fixed windows."""
from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Characters without a change between blank and not blank from which the tokenizer's own
#: code is used: the faster one slows down on such runs.
LONG_RUN = 1000
#: How byte-level tokenizers cut text before merging (a fixed value).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Text tokenised at a time: ids take more room than their text.
SLICE_BYTES = 1_000_000
#: The id after each document.
END = 1

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048,
         with_ids: bool = False) -> DataFrame:
    """Tokenise documents and pack them into sequences of at most ``window`` ids.

    ``tokenizer`` is the path of a tokenizer file, the same on every machine. A document
    is its ids without special ones, then the id 1; a null or empty text is that id alone.
    Returns one row per piece: ``doc_id``, ``start`` (its document's ids before it),
    ``length``, ``ids_crc32`` (of its ids as little-endian unsigned 32-bit numbers),
    ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence, gapless from 0), and with
    ``with_ids`` the ``ids``. Null ids and repeated rows are packed like any other, one
    document per row; other columns are ignored; an empty table gives no pieces.

    How: whole windows are cut off a document first. Its rest goes to the fill level that
    leaves the smallest sum of squared counts of partly filled windows, over an array of
    counts by level. At the end of a task's rows the windows still open are merged by
    cutting pieces, and what fills no window is split at powers of two, which are not
    padded: every sequence is ``window`` ids long or a power of two. Tasks pack alone:
    nothing is shuffled, and a task holds a slice of text and the open windows, which are
    at most one per level and usually far fewer. Sequence ids carry the task's number.
    """
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(window, task << 36)
        for part in T.slices(batches, limit=SLICE_BYTES):
            flat, offsets = tokens(T.one(part["text"]), tokenizer)
            for i, doc_id in enumerate(part["doc_id"].to_pylist()):
                packer.add(doc_id, flat[offsets[i]:offsets[i + 1]])
            yield _batch(packer.taken(), with_ids)
        packer.close()
        yield _batch(packer.taken(), with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        T.tidy(packed), _PIECES + (", ids array<int>" if with_ids else ""))


class Packer:
    """Windows of ``size`` ids; ``levels[f]`` counts the open ones that hold ``f``."""

    def __init__(self, size: int, first_id: int = 0):
        self.size, self.next_id = size, first_id
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.size:
            self._emit([(doc_id, start, ids[start:start + self.size], total)])
            start += self.size
        if start < total:
            self._place((doc_id, start, ids[start:].copy(), total))

    def _place(self, piece: tuple) -> None:
        need, levels = len(piece[2]), self.levels
        # Moving a window from level f to f + need changes the sum of squares by
        # 2 * (levels[f + need] - levels[f] + 1); a full one leaves the count.
        change = 2 * (levels[need:self.size + 1] - levels[:self.size + 1 - need] + 1)
        change[levels[:self.size + 1 - need] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * levels[need] + 1  # a new window
        if self.size - need > 0 and levels[self.size - need]:
            change[self.size - need] = 1 - 2 * levels[self.size - need]
        at = int(np.argmin(change))
        pieces = []
        if at:
            pieces = self.open[at].pop()
            levels[at] -= 1
        pieces.append(piece)
        if at + need == self.size:
            self._emit(pieces)
        else:
            levels[at + need] += 1
            self.open.setdefault(at + need, []).append(pieces)

    def close(self) -> None:
        """Merge the open windows, fullest first, into full ones and powers of two."""
        rest = [p for fill in sorted(self.open, reverse=True)
                for pieces in self.open[fill] for p in pieces]
        left = sum(len(p[2]) for p in rest)
        room, current = self._room(left), []
        while rest:
            doc_id, start, ids, total = rest.pop(0)
            if len(ids) > room:
                rest.insert(0, (doc_id, start + room, ids[room:], total))
                ids = ids[:room]
            current.append((doc_id, start, ids, total))
            room, left = room - len(ids), left - len(ids)
            if not room:
                self._emit(current)
                room, current = self._room(left), []
        self.open.clear()
        self.levels[:] = 0

    def _room(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(left.bit_length() - 1, 0)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                              total, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    if with_ids:
        names.append("ids")
        arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names)


# --- ids --------------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CODERS: dict[str, Callable[[str, bool], list[int]]] = {}


def tokens(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each text's followed by ``END``, and where each
    text's ids start."""
    code = _CODERS.get(path) or _CODERS.setdefault(path, _coder(path))
    texts = pc.fill_null(T.one(texts), "")
    found = []
    for text, odd in zip(texts.to_pylist(), _long_runs(texts), strict=True):
        ids = code(text, bool(odd))
        ids.append(END)
        found.append(np.array(ids, np.uint32))
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
    return np.concatenate([np.zeros(0, np.uint32), *found]), offsets


def _long_runs(texts: pa.Array) -> np.ndarray:
    """Which texts have a run of more than ``LONG_RUN`` bytes, all blank or none."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    blank = _BLANK[np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)]
    at = np.unique(np.concatenate([np.flatnonzero(blank[1:] != blank[:-1]) + 1, ends]))
    runs = np.diff(at, prepend=0)
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, at[runs > LONG_RUN], "left")] = True
    return out


def _coder(path: str) -> Callable[[str, bool], list[int]]:
    """Ids of a text by the tokenizer in ``path``. Where its merges stand in the order of
    their ids, a faster coder over the same vocabulary gives the same ids; texts that hold
    a special token or a long run go to the tokenizer itself."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = _ranks(spec)
    del spec  # tens of megabytes once parsed
    own = []

    def slow(text: str, odd: bool) -> list[int]:
        if not own:  # loaded when a text first needs it
            from tokenizers import Tokenizer
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            own.append(Tokenizer.from_file(path))
        return list(own[0].encode(text, add_special_tokens=False).ids)

    if ranks is None:
        return slow
    import tiktoken
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary

    def both(text: str, odd: bool) -> list[int]:
        return slow(text, odd) if odd or any(s in text for s in special) else fast(text)

    return both


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each mergeable token by id, or None where ids are not in merge order."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if (spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
            or not cut.get("use_regex") or model["type"] != "BPE"):
        return None
    # Byte-level vocabularies write printable bytes as themselves, others from U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = model["vocab"]
    for i, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        if vocabulary.get(left + right) != 256 + i:
            return None
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items()
            if i < 256 + len(model["merges"])}
