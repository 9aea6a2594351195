"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import labels as L
from . import neardup
from . import text as T

#: Most labelled rows that lexicons are drawn from and the models are fitted on.
SAMPLE = 12_000
#: Lexicon terms: word beginnings of these lengths and whole words (0); how many terms, in
#: how many toxic documents at least, and the least share of a term's documents that are toxic.
LENGTHS = (3, 4, 5, 6, 0)
TERMS, SEEN, PURE = 64, 4.5, 0.95
#: MinHash values by which near copies in the sample are counted as one.
KEYS = 8
#: Correlation given the class from which two voters share one say.
TIED = 0.3
#: Votes' worth of belief in the accuracies that voters start with; those of patterns, and
#: of having any term or none.
BELIEF, PATTERN, ANY = 50, 0.3, 0.95
TRIM = ".,!?;:\"'()[]{}|#$%&*<>-_~@^+=/\\…«»“”‘’"
#: Patterns that vote toxic, as least shares of a text's words.
SHOUTED, EXCLAIMED = 0.3, 0.3


@dataclass
class Lexicon:
    """Terms with their lengths, in the order of their voters; the share of each term's
    documents that are toxic, and that of all documents."""

    terms: list[tuple[int, str]] = field(default_factory=list)
    pure: list[float] = field(default_factory=list)
    toxic: float = 0.0

    def hits(self, w: T.Words) -> np.ndarray:
        """How often each text holds each term."""
        size = len(w.offsets) - 1
        out = np.zeros((size, len(self.terms)))
        if not self.terms or not len(w.codes):
            return out
        plain, owner = _plain(w.vocabulary), w.owner()
        for length in sorted({n for n, _ in self.terms}):
            at = [i for i, (n, _) in enumerate(self.terms) if n == length]
            found = pc.index_in(_start(plain, length), pa.array(
                [self.terms[i][1] for i in at], pa.string()))
            found = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)[w.codes]
            here = np.flatnonzero(found >= 0)
            np.add.at(out, (owner[here], np.array(at)[found[here]]), 1)
        return out


def _plain(vocabulary: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.utf8_trim(vocabulary, TRIM))


def _start(words: pa.Array, length: int) -> pa.Array:
    """The first letters of words that have so many (whole words for 0), else null."""
    if not length:
        return words
    return pc.if_else(pc.greater_equal(pc.utf8_length(words), length),
                      pc.utf8_slice_codeunits(words, 0, length), pa.scalar(None, pa.string()))


def measures(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: hits of each term, then its words and the shares of shouted words and of
    exclamation marks."""
    w = T.words(texts)
    words = np.maximum(w.counts, 1)
    if len(w.codes):
        upper, letters, marks = (pc.count_substring_regex(w.vocabulary, p).to_numpy(
            zero_copy_only=False)[w.codes] for p in (r"\p{Lu}", r"\p{L}", "!"))
        shouted, marks = w.per_text((letters > 1) & (upper == letters)), w.per_text(marks)
    else:
        shouted = marks = np.zeros(len(words))
    return np.column_stack([lexicon.hits(w), w.counts, shouted / words, marks / words])


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of each voter by text: 1 toxic, -1 clean, 0 none. One voter per term, two for
    patterns, one that votes by whether there is any term, and one clean for long texts
    without."""
    hits, words, shouted, marks = m[:, :-3], m[:, -3], m[:, -2], m[:, -1]
    none = hits.sum(1) == 0
    return np.column_stack([
        (hits > 0).astype(int), (shouted > SHOUTED).astype(int),
        (marks > EXCLAIMED).astype(int), 1 - 2 * none.astype(int),
        -(none & (words > 100)).astype(int)])


# --- generative label model -------------------------------------------------------------


@dataclass
class LabelModel:
    """``prior`` of toxic, and per voter how often it is right when it speaks; silence says
    nothing. Voters of one ``source`` go together beyond what the class explains: of those
    that speak on a text, the surest counts."""

    prior: float
    accuracy: np.ndarray
    source: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        said = v * np.log(self.accuracy / (1 - self.accuracy))
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for s in np.unique(self.source):
            part = said[:, self.source == s]
            odds += part[np.arange(len(v)), np.abs(part).argmax(1)]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_labels(v: np.ndarray, accuracy: np.ndarray, prior: float,
               rounds: int = 50) -> LabelModel:
    """Estimate voters' accuracies by expectation maximisation from their votes, starting
    from, and held by BELIEF votes to, the given ones; then their correlations given the
    class, and accuracies again with correlated voters sharing one say."""
    start = np.clip(accuracy, 0.05, 0.99)
    model = LabelModel(prior, start, np.arange(v.shape[1]))
    spoke = v != 0
    for stage in range(2):
        for _ in range(rounds):
            p = model.posterior(v)[:, None]
            right = np.where(v > 0, p, np.where(v < 0, 1 - p, 0)).sum(0)
            model.accuracy = np.clip(
                (right + BELIEF * start) / (spoke.sum(0) + BELIEF), 0.05, 0.995)
            model.prior = float((p.sum() + BELIEF * prior) / (len(v) + BELIEF))
        if stage == 0:
            model.source = _sources(spoke.astype(float), model.posterior(v))
    return model


def _sources(spoke: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Number voters so that those linked by strong correlations given the class share one."""
    tied = np.zeros((spoke.shape[1],) * 2, bool)
    for share in (1 - p, p):
        every = max(share.sum(), 1e-9)
        rest = spoke - share @ spoke / every
        together = (rest * share[:, None]).T @ rest / every
        scale = np.sqrt(np.maximum(np.diag(together), 1e-6))
        tied |= together / np.outer(scale, scale) > TIED
    source = np.arange(len(tied))
    for _ in source:
        least = np.where(tied, source, len(tied)).min(1, initial=len(tied))
        source, before = np.minimum(source, least), source
        if (source == before).all():
            break
    return source


# --- linear classifier ------------------------------------------------------------------


def inputs(m: np.ndarray) -> np.ndarray:
    """What the classifier sees of a text."""
    hits = m[:, :-3]
    return np.column_stack([
        np.ones(len(m)), hits > 0, np.log1p(hits.sum(1)), np.minimum((hits > 0).sum(1), 5),
        m[:, -2:]]).astype(float)


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression on posterior labels, by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty,
                               x.T @ (p - q) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Classifier:
    lexicon: Lexicon
    beta: np.ndarray | None  # None: nothing was learned, no text is toxic
    label_model: LabelModel | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(texts))
        odds = inputs(measures(texts, self.lexicon)) @ self.beta
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


# --- operator ---------------------------------------------------------------------------


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches):
        found, owner = neardup.shingles(T.one(part["text"]), 5)
        sig = neardup.signatures(found, owner, part.num_rows, KEYS).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [T.one(part["doc_id"]), pa.ListArray.from_arrays(
                pa.array(np.arange(0, sig.size + 1, KEYS), pa.int32()),
                pa.array(sig.reshape(-1)))], ["doc_id", "keys"])


def _weights(chosen: DataFrame) -> DataFrame:
    """``doc_id, weight``: one over the number of near copies a sampled document has in the
    sample, as the median of how many share each of its KEYS MinHash values. Without it, a
    document copied often would make each of its words a term."""
    rows = chosen.select("doc_id", "text").mapInArrow(
        _keyed, "doc_id long, keys array<long>").toArrow()
    keys = T.one(rows["keys"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, KEYS)
    share = np.ones(keys.shape)
    for k in range(KEYS):
        _, inverse, count = np.unique(keys[:, k], return_inverse=True, return_counts=True)
        share[:, k] = count[inverse]
    out = pd.DataFrame({"doc_id": rows["doc_id"].to_pandas(),
                        "weight": 1 / np.median(share, axis=1)}).groupby(
                            "doc_id", as_index=False).max()
    return chosen.sparkSession.createDataFrame(out, "doc_id long, weight double")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of documents by class, and by class of those that hold each word or word
    beginning."""
    seen: tuple[defaultdict, defaultdict] = defaultdict(float), defaultdict(float)
    rows = [0.0, 0.0]
    for part in T.slices(batches):
        w, (label, weight) = T.words(part["text"]), (
            T.one(part[c]).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
        plain = _plain(w.vocabulary)
        for length in LENGTHS:
            coded = pc.dictionary_encode(_start(plain, length))
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)[w.codes]
            size = max(len(coded.dictionary), 1)
            key = np.unique(w.owner()[code >= 0] * size + code[code >= 0])
            terms = coded.dictionary.to_pylist()
            for c in (0, 1):
                own = key[label[key // size] == c]
                total = np.bincount(own % size, weight[own // size], size)
                for t in np.flatnonzero(total):
                    seen[c][length, terms[t]] += total[t]
        rows = [rows[c] + float(weight[label == c].sum()) for c in (0, 1)]
    keys = list(seen[0].keys() | seen[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array([*(k[0] for k in keys), -1], pa.int32()),
         pa.array([*(k[1] for k in keys), ""], pa.string()),
         *(pa.array([*(seen[c].get(k, 0.0) for k in keys), rows[c]]) for c in (0, 1))],
        ["length", "term", "clean", "toxic"])


def draw_lexicon(chosen: DataFrame) -> Lexicon:
    """Terms that tell toxic documents, the strongest first; of terms one of which begins
    the other, the stronger. At most a few times TERMS come to the driver."""
    weighted = chosen.join(F.broadcast(_weights(chosen)), "doc_id")  # bounded by the sample
    counts = weighted.select("text", "label", "weight").mapInArrow(
        _counted, "length int, term string, clean double, toxic double") \
        .groupBy("length", "term").agg(*(F.round(F.sum(c), 6).alias(c) for c in (
            "clean", "toxic"))).where((F.col("length") < 0) | (F.col("toxic") >= SEEN)).checkpoint()
    rows = counts.where("length < 0").first()
    kept = F.col("toxic") >= PURE * (F.col("toxic") + F.col("clean"))
    best = counts.where((F.col("length") >= 0) & kept) \
        .orderBy(F.desc(F.col("toxic") - F.col("clean")), F.desc("length"), "term") \
        .limit(20 * TERMS).collect()
    out = Lexicon(toxic=rows.toxic / max(rows.toxic + rows.clean, 1e-9) if rows else 0.0)
    for row in best:
        if len(out.terms) < TERMS and not any(
                row.term.startswith(t) or t.startswith(row.term) for _, t in out.terms):
            out.terms.append((row.length, row.term))
            out.pure.append((row.toxic + 1) / (row.toxic + row.clean + 2))
    return out


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Classifier:
    """Draw a lexicon, let its voters vote on the same rows, and fit both models."""
    checkpoint_root(docs.sparkSession)
    chosen = L.labelled_texts(docs, L.sample(labels, "toxic", size))
    lexicon = draw_lexicon(chosen)
    if not lexicon.terms:
        return Classifier(lexicon, None)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            m = measures(T.one(part["text"]), lexicon)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
                pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()),
                pa.array(m.reshape(-1)))], ["m"])

    rows = T.one(chosen.mapInArrow(measured, "m array<double>").toArrow()["m"])
    m = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return fit(lexicon, m[np.lexsort(m.T)])  # sums then do not depend on the order of arrival


def fit(lexicon: Lexicon, m: np.ndarray) -> Classifier:
    accuracy = np.array([*lexicon.pure, PATTERN, PATTERN, ANY, ANY])
    model = fit_labels(votes(m), accuracy, min(max(lexicon.toxic, 0.01), 0.99))
    return Classifier(lexicon, fit_linear(inputs(m), model.posterior(votes(m))), model)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
             size: int = SAMPLE) -> DataFrame:
    """Score every whole text for toxicity.

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1); rows with other values, without an
    id, or held out (see ``labels.held_out``) teach nothing. Returns per row ``doc_id``,
    ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from
    ``threshold`` on). Null and empty texts are scored as texts without any term; equal
    texts have equal scores; repeated rows and null ids are scored like any other; other
    columns are ignored. Where no term tells toxic documents (no labels, one kind only, or
    none in SEEN of the sample's toxic documents) all scores are 0. An empty table gives an
    empty result. Limits of the lexicon, whatever the labels: a term is in at least SEEN
    (4.5) toxic documents of the sample, near copies counting as one; the strongest TERMS
    (64) of the first 20 * TERMS by toxic less clean documents are kept.

    How: words and word beginnings that toxic documents of a labelled sample hold, and
    clean ones hardly ever, become lexicon voters, beside voters for patterns and for the
    absence of terms. A generative model estimates from the votes how often each voter
    speaks in each class, starting from what the labelled sample showed of each term and
    held to it by BELIEF (50) votes' worth, and which voters go together, and gives each
    sampled text a posterior label. A linear classifier learns these posteriors and scores all texts
    in Arrow tasks. The sample's size is bounded; counting and scoring are distributed.
    """
    model = train(docs, labels, size)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            yield pa.RecordBatch.from_arrays(
                [T.one(part["doc_id"]), pa.array(model.score(T.one(part["text"])))],
                ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (rows.mapInArrow(scored, "doc_id long, score double")
            .withColumn("held_out", L.held_out(F.col("doc_id")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
