"""Canonical length-limited Huffman codes over arrays of ids, for use inside Arrow tasks."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import ResearchError

#: Ids between two checkpoints of a block; each stretch is decoded as a lane of its own.
STEP = 64
#: The longest code a 32-bit window can hold at any bit of a byte.
LONGEST = 25


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol's code: least total for these counts with no code over
    ``max_bits`` (package-merge). Equal counts go by position."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ResearchError(f"{n} symbols do not fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    packages, from_leaf = np.zeros(0, np.int64), []
    for _ in range(max_bits):
        items = np.concatenate([leaves, packages])
        rank = np.argsort(items, kind="stable")
        from_leaf.append(rank < n)
        items = items[rank]
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
    bits, wanted = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(from_leaf):
        taken = int(leaf[:wanted].sum())
        bits[order[:taken]] += 1
        wanted = 2 * (wanted - taken)
    return bits


@dataclass
class Code:
    """``ids`` with the ``bits`` of their codes. Codes are canonical: numbered upwards in
    the order of (bits, id), so the two arrays are the whole code book."""

    ids: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        order = np.lexsort([self.ids, self.bits])
        self.ids, self.bits = self.ids[order], self.bits[order].astype(np.int64)
        self.width = int(self.bits.max(initial=1))
        if self.width > LONGEST:
            raise ResearchError(f"codes of {self.width} bits are longer than {LONGEST}")
        share = np.int64(1) << (self.width - self.bits)
        first = np.cumsum(share) - share
        size = int(self.ids.max(initial=0)) + 1
        self._bits = np.zeros(size, np.int64)
        self._code = np.zeros(size, np.int64)
        self._bits[self.ids] = self.bits
        self._code[self.ids] = first >> (self.width - self.bits)
        # Decoding: any window of ``width`` bits shows its first id and that code's bits.
        self._symbol = np.zeros(1 << self.width, np.uint32)
        self._used = np.ones(1 << self.width, np.uint8)
        filled = int(share.sum())
        self._symbol[:filled] = np.repeat(self.ids, share)
        self._used[:filled] = np.repeat(self.bits, share)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The codes one after another, and the bits of every ``STEP`` ids (uint16)."""
        bits = self._bits[ids]
        if len(ids) and not bits.all():
            raise ResearchError("an id has no code")
        ends = np.cumsum(bits)
        begin = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        window = self._code[ids] << (32 - bits - (begin & 7))
        at, size = begin >> 3, (total + 7) // 8
        out = np.zeros(size + 4, np.int64)
        for k in range(4):  # codes share no bit, so adding is joining
            out += np.bincount(at + k, (window >> (24 - 8 * k)) & 255, size + 4).astype(np.int64)
        marks = ends[np.minimum(np.arange(STEP, len(ids) + STEP, STEP), len(ids)) - 1]
        return (out[:size].astype(np.uint8).tobytes(),
                np.diff(marks, prepend=0).astype("<u2").tobytes())

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block; all lanes advance together through the table."""
        spans = np.frombuffer(checkpoints, "<u2").astype(np.int64)
        if len(spans) != -(-n // STEP):
            raise ResearchError("a block's checkpoints do not fit its length")
        if not n:
            return np.zeros(0, np.uint32)
        data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        ends = np.cumsum(spans)
        if (int(ends[-1]) + 7) // 8 != len(payload):
            raise ResearchError("a block's bits do not fit its checkpoints")
        at, down = ends - spans, np.uint32(32 - self.width)
        out = np.empty((STEP, len(spans)), np.uint32)
        last = n - (len(spans) - 1) * STEP  # ids in the last lane
        for k in range(STEP):
            if k == last:
                if at[-1] != ends[-1]:
                    raise ResearchError("a block does not decode to its checkpoints")
                at = at[:-1]
            lanes = len(at)
            index = (words[at >> 3] << (at & 7).astype(np.uint32)) >> down
            out[k, :lanes] = self._symbol[index]
            at = at + self._used[index]
        if (at != ends[:len(at)]).any():
            raise ResearchError("a block does not decode to its checkpoints")
        return out.T.reshape(-1)[:n]
