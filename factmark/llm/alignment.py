"""Where two tokenizers' tokens end together, and which tokens correspond."""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, scratch_path
from . import text as T
from .tokenfile import binary, numbers

#: A single space between a character and a visible one: neither tokenizer's tokens cross it.
CUT = re.compile(r"(?<=[^ ]) (?=[!-~\w])")
#: What a chunk begins with that may follow a cut.
VISIBLE = re.compile(r"[!-~\w]")
#: Characters of chunks a worker remembers.
KEPT = 3_000_000
#: Chunks that A encodes as one text.
JOINED = 128

_FOUND = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def align(docs: DataFrame, byte_bpe: str, pieces: str, with_groups: bool = False) -> DataFrame:
    """Align two tokenizers over each document's bytes.

    A is a byte-level tokenizer file (``byte_bpe``) over a space and the text, B a piece
    model with byte fallback (``pieces``) over the text, which adds the space itself; both
    paths are the same on every machine. Special tokens' strings are plain text. Bytes at
    which a token of A and one of B both end cut both sequences into groups; the two tokens
    that end there are a link. A pair of ids has as its count how many links of the whole
    corpus hold it.

    Returns per row: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair has the highest count of its B id, ties included),
    ``count_sum`` (of the links' counts), ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``), and
    with ``with_groups`` that text as ``groups``. Null and empty texts, and texts whose
    tokens do not join to the same bytes again (B reads U+2581 as a space), have no tokens:
    zeros and an empty digest. Null ids and repeated rows are rows like any other; other
    columns are ignored; an empty table gives no rows.

    How: texts are cut where neither tokenizer's tokens cross, so every cut is a joint end, and
    a distinct chunk's ends are compared once: followed on both sides from the left. At the present shift
    between their positions ever longer stretches are compared; where one differs, halving
    finds how far the two still run together, and the irregular group there is resolved
    end by end, which sets the next shift. Of two tokens that end at one byte, one's bytes
    end the other's, so the pairs that can ever be linked follow from the two vocabularies:
    counts are an array over them, summed by Spark, and need no shuffle back to documents.
    """
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pair_coder(byte_bpe, pieces)
        for part in T.slices(batches):
            yield coder.aligned(T.one(part["doc_id"]), T.one(part["text"]), with_groups)

    held = scratch_path(spark, "aligned")
    groups = ", groups string" if with_groups else ""
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .mapInArrow(find, _FOUND + groups).write.option("compression", "zstd").parquet(held))
    found = spark.read.parquet(held)
    keys, n_b = _linkable(byte_bpe, pieces)
    size = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(numbers(batch.column("links"), "<u4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    counted = (found.select("links").mapInArrow(count, "pair long, n long").groupBy("pair")
               .agg(F.sum("n").alias("n")).toArrow())  # at most a row per linkable pair
    counts = np.zeros(size, np.int64)
    counts[T.one(counted["pair"]).to_numpy()] = T.one(counted["n"]).to_numpy()
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, keys % n_b, counts)
    best = counts == highest[keys % n_b]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = numbers(batch.column("links"), "<u4")
            ends = np.concatenate([[0], np.cumsum(batch.column("n_groups").to_numpy())])

            def summed(values: np.ndarray) -> pa.Array:
                upto = np.concatenate([[0], np.cumsum(values[links], dtype=np.int64)])
                return pa.array(upto[ends[1:]] - upto[ends[:-1]])

            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
                + [summed(best), summed(counts), batch.column("groups_sha256")]
                + ([batch.column("groups")] if with_groups else []), names=names)

    fields = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
              "count_sum long, groups_sha256 string" + groups)
    names = [f.split()[0] for f in fields.split(", ")]
    return found.mapInArrow(judge, fields)


def joint_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two rising lists of token ends at which they hold the same end, by
    diagonal runs. Both lists end with the same value."""
    i = j = 0
    n, m = len(a), len(b)
    rows, columns, sizes = [], [], []
    while i < n and j < m:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: its end sets the next shift
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        size, step, room = 1, 1, min(n - i, m - j)
        while size + step <= room and a[i + size:i + size + step] == b[j + size:j + size + step]:
            size += step
            step *= 2
        while step > 1:
            step >>= 1
            if size + step <= room and a[i + size:i + size + step] == b[j + size:j + size + step]:
                size += step
        rows.append(i)
        columns.append(j)
        sizes.append(size)
        i += size
        j += size
    sizes = np.array(sizes, np.int64)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (np.repeat(np.array(rows, np.int64), sizes) + inside,
            np.repeat(np.array(columns, np.int64), sizes) + inside)


# --- the two tokenizers -------------------------------------------------------------------

_CODERS: dict[tuple[str, str], PairCoder] = {}
_LINKABLE: dict[tuple[str, str], tuple[np.ndarray, int]] = {}


def pair_coder(byte_bpe: str, pieces: str) -> PairCoder:
    """One per process: its memory of chunks serves all tasks of a worker."""
    key = (byte_bpe, pieces)
    return _CODERS.get(key) or _CODERS.setdefault(key, PairCoder(byte_bpe, pieces))


def _byte_level():
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _a_bytes(tokenizer) -> list[bytes]:
    byte = _byte_level()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in byte for c in token):
            out[i] = bytes(byte[c] for c in token)
    return out


def _b_bytes(model) -> list[bytes]:
    return [bytes([int(piece[1:-1], 16)]) if model.is_byte(i)
            else b"" if model.is_control(i) or model.is_unknown(i)
            else piece.replace("▁", " ").encode()
            for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


def _load(byte_bpe: str, pieces: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(byte_bpe)
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=pieces)


def _linkable(byte_bpe: str, pieces: str) -> tuple[np.ndarray, int]:
    """All pairs, as rising numbers a * n_b + b, of which one token's bytes end the
    other's; and n_b. Their number is bounded by the bytes of both vocabularies."""
    key = (byte_bpe, pieces)
    if key not in _LINKABLE:
        tokenizer, model = _load(byte_bpe, pieces)
        sides, found = [_a_bytes(tokenizer), _b_bytes(model)], []
        named: list[dict[bytes, list[int]]] = [{}, {}]
        for of, tokens in zip(named, sides, strict=True):
            for i, token in enumerate(tokens):
                if token:
                    of.setdefault(token, []).append(i)
        for a, token in enumerate(sides[0]):
            found += [(a, b) for at in range(len(token)) for b in named[1].get(token[at:], ())]
        for b, token in enumerate(sides[1]):
            found += [(a, b) for at in range(1, len(token)) for a in named[0].get(token[at:], ())]
        n_b = len(sides[1])
        pairs = np.array(found, np.int64).reshape(-1, 2)
        _LINKABLE[key] = np.unique(pairs[:, 0] * n_b + pairs[:, 1]), n_b
    return _LINKABLE[key]


class PairCoder:
    """Both tokenizers' tokens of texts, aligned. Texts are cut where neither's tokens cross,
    so that tokens of both end there; each distinct chunk is encoded and aligned once and
    remembered, and a text's groups are those of its chunks, one after another."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.a, self.b = _load(byte_bpe, pieces)
        self.bytes = _a_bytes(self.a), _b_bytes(self.b)
        self.lengths = [np.array([len(t) for t in side], np.int64) for side in self.bytes]
        self.keys, self.n_b = _linkable(byte_bpe, pieces)
        # No piece may hold a space after another character, else tokens could cross a cut.
        self.cuts = all(b" " not in t.lstrip(b" ") for t in self.bytes[1])
        self.digits = [_decimal(len(side)) for side in self.bytes]
        self.known: dict[str, int] = {}
        self.chars = 0
        self.said: list[bytes] = []  # the groups as text, per chunk
        self.links = _Runs(np.uint32)
        self.counts = _Runs()  # per chunk: tokens of A, of B, groups; 0, or -1 if bytes were lost
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the chunks met most, of those met again, up to two thirds of KEPT."""
        chunks = list(self.known)
        weights = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 8
        order = np.argsort(-self.uses, kind="stable")
        order = order[(np.cumsum(weights[order]) <= KEPT * 2 // 3) & (self.uses[order] > 1)]
        links, sizes = self.links.take(order)
        counts, fours = self.counts.take(order)
        self.known = {chunks[at]: k for k, at in enumerate(order.tolist())}
        self.said = [self.said[at] for at in order.tolist()]
        self.links, self.counts = _Runs(np.uint32), _Runs()
        self.links.add(links, sizes)
        self.counts.add(counts, fours)
        self.uses = self.uses[order] // 2
        self.chars = int(weights[order].sum())

    def _a_ids(self, new: list[str], raw_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all chunks and how many are whose. Chunks that may follow one another
        at a cut are encoded as one text, whose tokens then end where a chunk does."""
        spaced = [" " + c for c in new]
        if self.cuts:
            first = [k for k, c in enumerate(new)
                     if k % JOINED == 0 or not VISIBLE.match(c) or new[k - 1].endswith(" ")]
            texts = ["".join(spaced[s:e]) for s, e in pairwise([*first, len(new)])]
            flat, _ = _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
            sizes = self.lengths[0][flat]
            ends = np.cumsum(sizes)
            at = np.searchsorted(ends, raw_ends)
            if sizes.all() and len(ends) and ends[-1] == raw_ends[-1] and (ends[at] == raw_ends).all():
                return flat, np.diff(at + 1, prepend=0)
        return _flat([e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)])

    def _codes(self, chunks: list[str]) -> np.ndarray:
        codes = list(map(self.known.get, chunks))
        if None in codes:
            new = [at for at, k in enumerate(codes) if k is None]
            self._learn(list(dict.fromkeys([chunks[at] for at in new])))
            for at in new:
                codes[at] = self.known[chunks[at]]
        return np.array(codes, np.int64)

    def _learn(self, new: list[str]) -> None:
        raw = [b" " + c.encode() for c in new]
        raw_ends, whole = np.cumsum([len(r) for r in raw]), b"".join(raw)
        ids, ends, of = [], [], []
        sound = np.ones(len(new), bool)
        for side in (0, 1):
            flat, sizes = (_flat(self.b.encode(new, num_threads=1)) if side
                           else self._a_ids(new, raw_ends))
            of.append(np.repeat(np.arange(len(new)), sizes))
            ids.append(flat)
            joined = b"".join(map(self.bytes[side].__getitem__, flat.tolist()))
            own_ends = np.concatenate([[0], np.cumsum(self.lengths[side][flat])])[np.cumsum(sizes)]
            if joined != whole or not np.array_equal(own_ends, raw_ends):
                own = own_ends.tolist()
                sound &= np.array([joined[s:e] == r for s, e, r in zip([0, *own[:-1]], own, raw, strict=True)])
        for side in (0, 1):
            if not sound.all():
                kept = sound[of[side]]
                ids[side], of[side] = ids[side][kept], of[side][kept]
            ends.append(np.cumsum(self.lengths[side][ids[side]]))
        i, j = joint_ends(ends[0].tolist(), ends[1].tolist())
        links = np.searchsorted(self.keys, ids[0][i] * self.n_b + ids[1][j]).astype(np.uint32)
        n = [np.bincount(x, minlength=len(new)) for x in (*of, of[0][i])]
        self.links.add(links, n[2])
        n.append(sound - 1)
        self.counts.add(np.stack(n, 1).ravel(), np.full(len(new), 4))
        text, sizes = self._written(ids, (i, j))
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n[0] + n[1])])].tolist()
        text = text.tobytes()
        self.said += [text[s:e - 1] if e > s else b"" for s, e in pairwise(upto)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.chars += sum(map(len, new)) + 8 * len(new)

    def aligned(self, doc_ids: pa.Array, texts: pa.Array, with_groups: bool) -> pa.RecordBatch:
        if self.chars > KEPT:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.string()), "").to_pylist()
        parts = [CUT.split(t) if t and self.cuts else [t] if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        codes = self._codes(list(chain.from_iterable(parts)))
        sound = self.counts.flat.reshape(-1, 4)[codes, 3] == 0
        if not sound.all():  # judged as a whole; if the bytes still differ, no tokens
            odd = np.unique(owner[~sound])
            whole = self._codes([texts[i] for i in odd])
            keep = ~np.isin(owner, odd)
            fine = self.counts.flat.reshape(-1, 4)[whole, 3] == 0
            owner = np.concatenate([owner[keep], odd[fine]])
            order = np.argsort(owner, kind="stable")
            owner, codes = owner[order], np.concatenate([codes[keep], whole[fine]])[order]
        used = np.bincount(codes, minlength=len(self.known))
        used[:len(self.uses)] += self.uses
        self.uses = used
        upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        per_chunk = self.counts.flat.reshape(-1, 4)[codes, :3]
        totals = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(per_chunk, 0)])[upto]
        n_a, n_b, groups = np.diff(totals, axis=0).T
        links, _ = self.links.take(codes)
        spoken = list(map(self.said.__getitem__, codes.tolist()))
        shown = [b";".join(spoken[s:e]) for s, e in pairwise(upto.tolist())]
        columns = [doc_ids, pa.array(n_a), pa.array(n_b), pa.array(groups),
                   pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in shown]),
                   binary(links, totals[:, 2])]
        names = [f.split()[0] for f in _FOUND.split(", ")]
        if with_groups:
            columns.append(pa.array([s.decode() for s in shown]))
            names.append("groups")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def _written(self, ids: list[np.ndarray], last: tuple[np.ndarray, np.ndarray]):
        """All groups as text, each token with the sign after it; and its characters."""
        total = len(ids[0]) + len(ids[1])
        closing = [np.zeros(len(x), np.int64) for x in ids]  # groups closed before a token
        for side in (0, 1):
            closing[side][last[side][:-1] + 1] = 1
        group = [np.cumsum(c) for c in closing]
        place = (np.arange(len(ids[0])) + np.concatenate([[0], last[1] + 1])[group[0]],
                 np.arange(len(ids[1])) + (last[0] + 1)[group[1]] if len(last[0]) else np.zeros(0, np.int64))
        width = max(d.shape[1] for d, _ in self.digits) + 1
        text = np.zeros((total, width), np.uint8)
        size = np.zeros(total, np.int64)
        for side, sign in ((0, "|"), (1, ";")):
            digits, lengths = self.digits[side]
            text[place[side], :digits.shape[1]] = digits[ids[side]]
            size[place[side]] = lengths[ids[side]]
            mark = np.full(len(ids[side]), ord(","), np.uint8)
            mark[last[side]] = ord(sign)
            text[place[side], size[place[side]]] = mark
        shown = np.arange(width) <= size[:, None]
        return np.ascontiguousarray(text[shown]), size + 1


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and their lengths."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class _Runs:
    """A growing array of runs of different lengths."""

    def __init__(self, kind=np.int64):
        self._flat, self._begin = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64)
        self._used = self._n = 0

    @property
    def flat(self) -> np.ndarray:
        return self._flat[:self._used]

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self._used + len(values) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._n + len(sizes) + 1 > len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
        self._flat[self._used:self._used + len(values)] = values
        self._begin[self._n + 1:self._n + 1 + len(sizes)] = self._used + np.cumsum(sizes)
        self._used += len(values)
        self._n += len(sizes)

    def take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs one after another, and their lengths."""
        begin = self._begin[runs]
        sizes = self._begin[runs + 1] - begin
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)
        return self._flat[at], sizes


def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to n - 1 from the left, and how many."""
    shown = np.array([str(i) for i in range(max(n, 1))], "S")
    lengths = np.char.str_len(shown)
    return shown.view(np.uint8).reshape(len(shown), -1), lengths
