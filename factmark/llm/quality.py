"""Quality scores from a generalised additive model with pairwise interactions."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as L
from . import text as T

#: Text measured at a time: its words and their hashes take many times its room.
SLICE_BYTES = 1_000_000
#: Most labelled rows that a model is fitted on.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 12
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 150, 60, 0.15, 5.0

FEATURES = ("words", "word_chars", "long_words", "upper", "shouted", "digits", "symbols",
            "bare_symbols", "symbol_words", "exclaimed", "ended", "distinct", "commonest",
            "stuttered", "again_2", "again_5", "same_lines", "line_words", "odd_chars",
            "doubled")


# --- features ---------------------------------------------------------------------------


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; zeros where there are no words."""
    texts = pc.fill_null(T.one(texts), "")
    w, size = T.words(texts), len(texts)
    vocabulary = w.vocabulary

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(vocabulary, pattern).to_numpy(zero_copy_only=False)

    chars = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)
    upper, letters, digits = count(r"\p{Lu}"), count(r"\p{L}"), count(r"\p{N}")
    symbols = count(r"[#*$%&|<>@^~={}\[\]\\/_+]")
    ends = pc.match_substring_regex(vocabulary, r"[.!?…][\"')\]]*$").to_numpy(zero_copy_only=False)
    marks = {
        "word_chars": chars, "long_words": chars > 20, "upper": upper,
        "shouted": (letters > 1) & (upper == letters), "digits": digits, "symbols": symbols,
        "bare_symbols": (letters + digits == 0), "symbol_words": symbols > 0,
        "exclaimed": count("!"), "ended": ends,
        "odd_chars": chars - letters - digits, "doubled": count(r"[!?.,;:#*$%&|]{2,}"),
    }
    words = np.maximum(w.counts, 1)
    sums = {k: w.per_text(v[w.codes]) if len(w.codes) else np.zeros(size, np.int64)
            for k, v in marks.items()}
    letters_in = np.maximum(w.per_text(letters[w.codes]) if len(w.codes) else 0, 1)
    chars_in = np.maximum(sums["word_chars"], 1)
    out = {"words": np.log1p(w.counts), "word_chars": sums["word_chars"] / words,
           "upper": sums["upper"] / letters_in}
    out |= {k: sums[k] / chars_in for k in ("digits", "symbols", "odd_chars")}
    out |= {k: sums[k] / words for k in ("long_words", "shouted", "bare_symbols", "symbol_words",
                                         "exclaimed", "ended", "doubled")}
    owner = w.owner()
    pair = np.sort(owner * max(len(vocabulary), 1) + w.codes)
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    first = np.flatnonzero(new)
    holder = pair[first] // max(len(vocabulary), 1)
    times = np.diff(np.append(first, len(pair)))
    most = np.zeros(size)
    np.maximum.at(most, holder, times)
    same = np.zeros(len(owner), bool)
    same[1:] = (w.codes[1:] == w.codes[:-1]) & (owner[1:] == owner[:-1])
    out |= {"distinct": np.bincount(holder, minlength=size) / words, "commonest": most / words,
            "stuttered": w.per_text(same) / words}
    hashes = w.hashes()
    salt = T.mixed(np.arange(1, size + 1, dtype=np.uint64))[owner]
    for n in (2, 5):
        at = T.whole(w.offsets, n)
        again = T.covered(at[T.twice(T.rolling(hashes, n)[at] ^ salt[at])], n, len(hashes))
        out[f"again_{n}"] = w.per_text(again) / words
    lines = pc.split_pattern(texts, "\n")
    per_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    codes = pc.dictionary_encode(T.one(lines.flatten())).indices.to_numpy(zero_copy_only=False)
    holder = np.repeat(np.arange(size), per_text)
    distinct = np.unique(holder * (int(codes.max(initial=0)) + 1) + codes)
    kept = np.bincount(distinct // (int(codes.max(initial=0)) + 1), minlength=size)
    out["same_lines"] = 1 - kept / np.maximum(per_text, 1)
    out["line_words"] = np.log1p(w.counts / np.maximum(per_text, 1))
    return np.column_stack([np.asarray(out[f], float) for f in FEATURES])


# --- model ------------------------------------------------------------------------------


@dataclass
class Additive:
    """Bin edges per feature, one table per feature, and tables of pairs of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # fine bin to coarse bin
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: a sum of looked-up bins through the logistic curve."""
        out, at = np.full(len(x), self.intercept), self.bins(x)
        for table, b in zip(self.tables, at, strict=True):
            out += table[b]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Additive:
    """Boost in turn one shallow tree per feature, then one per chosen pair.

    Without rows, or with one label only, the model is the share of label 1, counted with
    one row of label 1 more (no rows: 1)."""
    share = min((y.sum() + 1) / (len(y) + 1), 1 - 1e-6)
    model = Additive(float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1],
                                         method="lower")) for i in range(x.shape[1])]
    at = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    raw = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for i, b in enumerate(at):
            g, h = _slope(raw, y)
            step = RATE * _tree(np.bincount(b, g, sizes[i]), np.bincount(b, h, sizes[i]))
            model.tables[i] += step
            raw += step[b]
    model.coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in sizes]
    low = [c[b] for c, b in zip(model.coarse, at, strict=True)]
    g, h = _slope(raw, y)
    gain = {}
    for i in range(len(at)):
        for j in range(i):
            cell = low[i] * PAIR_BINS + low[j]
            gain[j, i] = _quadrants(*(np.bincount(cell, v, PAIR_BINS**2).reshape(
                PAIR_BINS, PAIR_BINS).T for v in (g, h)))[0]
    model.pairs = sorted(gain, key=lambda p: (-gain[p], p))[:PAIRS]
    model.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(min(rounds, PAIR_ROUNDS)):
        for grid, (i, j) in zip(model.grids, model.pairs, strict=True):
            g, h = _slope(raw, y)
            cell = low[i] * PAIR_BINS + low[j]
            step = RATE * _quadrants(*(np.bincount(cell, v, PAIR_BINS**2).reshape(
                PAIR_BINS, PAIR_BINS) for v in (g, h)))[1]
            grid += step
            raw += step[low[i], low[j]]
    return model


def _slope(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return y - p, p * (1 - p)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps by bin of a tree with at most three leaves: the best cut, then the best cut
    of one of its sides."""
    cuts = [0, len(g)]
    g0, h0 = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            won = (_gain(g0[c] - g0[a], h0[c] - h0[a]) + _gain(g0[b] - g0[c], h0[b] - h0[c])
                   - _gain(g0[b] - g0[a], h0[b] - h0[a]))
            k = int(np.argmax(won))
            if won[k] > best[0]:
                best = (won[k], int(c[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g0[b] - g0[a]) / (h0[b] - h0[a] + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the steps of a tree that cuts both features of a pair once."""
    def corner(v: np.ndarray) -> np.ndarray:
        out = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
        out[1:, 1:] = v.cumsum(0).cumsum(1)
        return out
    cg, ch = corner(g), corner(h)
    inner = (slice(1, -1), slice(1, -1))
    parts = []
    for c in (cg, ch):
        low, left, top, every = c[inner], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        parts.append((low, left - low, top - low, every - left - top + low))
    total = sum(_gain(a, b) for a, b in zip(*parts, strict=True))
    i, j = np.unravel_index(np.argmax(total), total.shape)
    values = [a[i, j] / (b[i, j] + SMOOTH) for a, b in zip(*parts, strict=True)]
    out = np.empty(g.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:] = values[0], values[1]
    out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values[2], values[3]
    return float(total[i, j] - _gain(cg[-1, -1], ch[-1, -1])), out


# --- operator ---------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Additive:
    """Fit on at most about ``size`` labelled rows, whose features come to the driver."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, limit=SLICE_BYTES):
            x = features(T.one(part["text"]))
            yield pa.RecordBatch.from_arrays(
                [T.one(part["label"]), pa.FixedSizeListArray.from_arrays(
                    pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))],
                ["label", "x"])

    rows = L.labelled_texts(docs, L.sample(labels, "quality", size)).mapInArrow(
        T.tidy(measured), "label int, x array<double>").toArrow()
    x = T.one(rows["x"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = T.one(rows["label"]).to_numpy(zero_copy_only=False).astype(float)
    order = np.lexsort((*x.T, y))  # sums then do not depend on the order of arrival
    return fit(x[order], y[order])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
            size: int = SAMPLE, carry: list[str] = ()) -> DataFrame:
    """Score every whole text for quality.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1); rows with other values, without an
    id, or held out (see ``labels.held_out``) teach nothing. Returns per row ``doc_id``,
    ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` (1 from
    ``threshold`` on) and the columns ``carry``, of which ``doc_id`` and ``score`` are left
    out and ``held_out`` and ``predicted`` give way to the results of that name. Null and empty texts are scored by their
    features, all zero; equal texts have equal scores; repeated rows and null ids are
    scored like any other. Without labels of both kinds all rows get the share of label 1.
    An empty table gives an empty result.

    How: features are counted in Arrow tasks. A generalised additive model is boosted on
    a sample of labelled rows of bounded size, one shallow tree per feature in turn, then
    trees over the pairs of features that explain most of what is left; each tree is added
    to its feature's table of bins, so that scoring is a sum of looked-up values.
    """
    model = train(docs, labels, size)
    carry = [c for c in carry if c not in ("doc_id", "score")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, limit=SLICE_BYTES):
            score = model.score(features(T.one(part["text"]))) if model.tables else \
                np.full(part.num_rows, 1 / (1 + np.exp(-model.intercept)))
            table = part.select(["doc_id", *carry]).append_column("score", pa.array(score))
            yield from table.combine_chunks().to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry,
                       *([] if "text" in carry else ["text"]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema
                     if f.name in ("doc_id", *carry))
    out = rows.mapInArrow(T.tidy(scored), kept + ", score double")
    return out.withColumn("held_out", L.held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
