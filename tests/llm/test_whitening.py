import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factmark.errors import ResearchError
from factmark.llm import spectrum
from factmark.llm.whitening import whiten


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 3.0, 1) for i, v in rows],
                                 "vec_id long, embedding array<double>, whitened double, n int").repartition(parts)


def brute(rows, k=16, scale=64):
    """The contract in plain numpy."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}), float)
    n, mean = len(fit), fit.mean(axis=0)
    centred = fit - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    values, vectors = values[order], vectors[:, order]
    s = [sum(int(f[j]) for f in fit) for j in range(fit.shape[1])]
    out = {}
    for i, v in kept:
        far = sum((n * x - t) ** 2 for x, t in zip(v, s, strict=True))
        out.setdefault(i, []).append((n, far, (np.array(v) - mean) @ vectors / np.sqrt(values)))
    return out, values / np.trace(centred.T @ centred / n)


def test_rows_match_brute_force(spark):
    r = np.random.default_rng(7)
    mixed = r.normal(size=(300, 20)) @ r.normal(size=(20, 20)) * 0.2
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(150)] + [(None, rows[9][1]), (5, rows[8][1])]
    odd = [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20),
           (904, [float("inf")] + [0.0] * 19), (905, [1.0] * 3)]
    got = whiten(frame(spark, rows + odd)).collect()
    want, explained = brute(rows)
    assert len(got) == 16 * len(rows)
    signs = {}
    for g in got:
        options = want[g.vec_id]
        assert any(o[:2] == (g.n, g.deviation) for o in options) and g.deviation_exact == g.deviation
        assert g.explained == pytest.approx(explained[g.component - 1], rel=1e-9)
        assert g.identity_error < 1e-9
        if len(options) == 1 and abs(options[0][2][g.component - 1]) > 1e-3:
            signs.setdefault(g.component, set()).add(
                round(g.whitened / options[0][2][g.component - 1], 6))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 16


def test_equal_eigenvalues_and_low_rank(spark):
    corners = [[a, b, 0.0, a] for a in (-1.0, 1.0) for b in (-1.0, 1.0)]
    got = whiten(frame(spark, list(enumerate(corners)))).collect()
    assert {g.component for g in got} == {1, 2}  # two dimensions vary, one twice as much
    assert [round(g.explained, 6) for g in got if g.vec_id == 0] == [0.666667, 0.333333]
    square = [[a, b] for a in (-1.0, 1.0) for b in (-1.0, 1.0)]
    got = whiten(frame(spark, list(enumerate(square)))).collect()
    assert {round(g.explained, 9) for g in got} == {0.5} and got[0].identity_error < 1e-12


def test_nothing_to_whiten(spark):
    same = frame(spark, [(i, [0.5, 0.25]) for i in range(50)])
    assert whiten(same).collect() == [] and whiten(same.where("false")).collect() == []
    assert whiten(same).columns == whiten(frame(spark, [(0, [1.0]), (1, [2.0])])).columns
    with pytest.raises(ResearchError):
        whiten(frame(spark, [(0, [1e300, 0.0]), (1, [0.0, 1.0])]))


def test_large_sums_stay_exact(spark):
    big = 2.0**43
    rows = [(i, [big * i, -big, float(i)]) for i in range(5)]
    got = whiten(frame(spark, rows)).collect()
    n, s = 5, [64 * int(big) * 10, -5 * 64 * int(big), 640]
    for g in got:
        x = [64 * int(big) * g.vec_id, -64 * int(big), 64 * g.vec_id]
        far = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert g.deviation_exact == far and g.deviation == (far if far < 2**63 else None)


def test_a_third_of_all_rows_alike(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 6)))] + [(None, [0.1] * 6)] * 200
    got = whiten(frame(spark, rows, 9)).collect()
    assert len(got) == 6 * 600 and got[0].n == 401 and got[0].identity_error < 1e-9


def determinant(m):
    if len(m) == 1:
        return m[0][0]
    return sum((-1) ** j * m[0][j] * determinant([row[:j] + row[j + 1:] for row in m[1:]])
               for j in range(len(m)))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10**6))
def test_polynomial_is_exact(d, seed):
    r = np.random.default_rng(seed)
    x = r.integers(-50, 50, size=(d + 2, d)).astype(object)
    if seed % 3 == 0 and d > 1:
        x[:, 0] = x[:, 1]
    m = x.T @ x * 10**12
    primes = spectrum.primes_for(m)
    poly = spectrum.joined(primes, [spectrum.polynomial_mod(m, p) for p in primes])
    for at in (0, 1, -3, 10**13):
        want = determinant([[at * (i == j) - int(m[i, j]) for j in range(d)] for i in range(d)])
        assert sum(c * at**i for i, c in enumerate(poly)) == want


def test_roots_and_vectors_of_known_spectra():
    poly = [1]
    for root in (0, 3, 3, 3, 7, 10**12, 10**12 + 1):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    found = spectrum.largest_roots(poly, 5)
    assert [n for _, n in found] == [1, 1, 1, 3]
    for (got, _), want in zip(found, (10**12 + 1, 10**12, 7, 3), strict=True):
        assert abs(got - want) <= Fraction(want, 1 << 118)
    m = np.diag([5, 5, 2]).astype(object)
    m[0, 2] = m[2, 0] = 0
    pair = spectrum.eigenvectors(m, Fraction(5), 2)
    assert np.allclose(pair @ pair.T, np.eye(2), atol=1e-15) and np.allclose(pair[:, 2], 0)


def test_close_eigenvalues_keep_double_precision():
    gap = 10**14
    m = np.array([[gap, 1, 0], [1, gap, 0], [0, 0, 5]], object)  # eigenvalues gap + 1, gap - 1
    poly = spectrum.joined(ps := spectrum.primes_for(m), [spectrum.polynomial_mod(m, p) for p in ps])
    (first, _), (second, _) = spectrum.largest_roots(poly, 2)
    v, w = (spectrum.eigenvectors(m, r, 1)[0] for r in (first, second))
    assert np.allclose(np.abs(v[:2]), math.sqrt(0.5), atol=1e-15)
    assert abs(v @ w) < 1e-15 and v[0] * v[1] > 0 > w[0] * w[1]
