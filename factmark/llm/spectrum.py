"""Eigenvalues and eigenvectors of a symmetric integer matrix from its exact characteristic
polynomial. Matrices are numpy arrays of Python ints."""
from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np

#: Relative width, in bits, to which a root is narrowed; roots nearer than this are one.
ROOT_BITS = 120
#: Bits after the point while components are solved for.
SOLVE_BITS = 400


def primes_for(matrix: np.ndarray) -> list[int]:
    """31-bit primes whose product passes twice any coefficient of the polynomial of a
    matrix without negative eigenvalues (Maclaurin's bound by the trace)."""
    d, trace = len(matrix), max(int(np.trace(matrix)), 1)
    mean = math.log2(trace) - math.log2(d) if d else 0.0
    bits = max([math.log2(math.comb(d, k)) + k * mean for k in range(d + 1)]) + 8
    found, at, product = [], (1 << 31) - 1, 0.0
    while product <= bits:
        if _is_prime(at):
            found.append(at)
            product += math.log2(at)
        at -= 2
    return found


def _is_prime(n: int) -> bool:
    """Miller-Rabin; the bases settle every number below 2**32."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if base % n == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - matrix) modulo ``p``, lowest first: Hessenberg form by
    similarity over the field, then the recurrence over its leading blocks."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        share = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - share[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * share % p).sum(axis=1)) % p
    rows = np.zeros((d + 1, d + 1), np.int64)
    rows[0, 0] = 1
    for k in range(1, d + 1):
        weights, chain = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k - 1]) * chain % p
        rows[k, 1:] = rows[k - 1, :-1]
        rows[k] = (rows[k] - (weights[:, None] * rows[:k] % p).sum(axis=0)) % p
    return rows[d]


def joined(primes: list[int], residues: list[np.ndarray]) -> list[int]:
    """Signed whole coefficients from their residues (Chinese remainders)."""
    product = math.prod(primes)
    parts = [product // p * pow(product // p, -1, p) for p in primes]
    out = []
    for at in range(len(residues[0])):
        c = sum(int(r[at]) * part for r, part in zip(residues, parts, strict=True)) % product
        out.append(c - product if 2 * c > product else c)
    return out


def largest_roots(poly: list[int], k: int) -> list[tuple[Fraction, int]]:
    """The ``k`` largest positive roots of a polynomial that has only real ones, each with
    how many fall together within ``ROOT_BITS``. Descartes' rule counts them exactly: the
    roots above a point are the sign changes of the polynomial shifted there."""
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    d = len(poly) - 1
    top = 1 + max((abs(c).bit_length() - 1) // (d - i) + 1 for i, c in enumerate(poly[:-1])) \
        if d else 0  # |root| <= 2 max |c_i|^(1 / (d - i))
    found: list[tuple[Fraction, int]] = []
    have = 0
    stack = [(0, 1 << top, 0, d, 0)] if d else []  # low, high over 2**s; roots above each
    while stack and have < k:
        low, high, s, above_low, above_high = stack.pop()
        count = above_low - above_high
        if not count:
            continue
        if count == 1:
            found.append((_narrowed(poly, low, high, s), 1))
            have += 1
            continue
        if low and (high - low) << ROOT_BITS <= low:
            found.append((Fraction(low + high, 2 << s), count))
            have += count
            continue
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        above = _changes(poly, mid, s)
        stack.append((low, mid, s, above_low, above))
        stack.append((mid, high, s, above, above_high))  # the upper part first
    return found


def _changes(poly: list[int], at: int, s: int) -> int:
    d = len(poly) - 1
    c = [x << (s * (d - i)) for i, x in enumerate(poly)]
    for i in range(d):
        carry = c[d]
        for j in range(d - 1, i - 1, -1):
            carry = c[j] + at * carry
            c[j] = carry
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int, s: int) -> int:
    v, d = 0, len(poly) - 1
    for i in range(d, -1, -1):
        v = v * at + (poly[i] << (s * (d - i)))
    return v


def _narrowed(poly: list[int], low: int, high: int, s: int) -> Fraction:
    """The only root in (low, high], all over 2**s: signs are compared with that at high."""
    end = _value(poly, high, s)
    if not end:
        return Fraction(high, 1 << s)
    while not low or (high - low) << ROOT_BITS > low:
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        v = _value(poly, mid, s)
        if not v:
            return Fraction(mid, 1 << s)
        if (v > 0) == (end > 0):
            high = mid
        else:
            low = mid
    return Fraction(low + high, 2 << s)


def eigenvectors(matrix: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal vectors of the null space of ``matrix - root``, one per row, to
    double precision: inverse iteration in fixed-point numbers of ``SOLVE_BITS`` bits."""
    d, bits = len(matrix), SOLVE_BITS
    size = max(int(abs(matrix).max()), 1).bit_length()
    a = np.array([[(int(x) << bits) >> size for x in row] for row in matrix], object)
    shift = (root.numerator << bits) // (root.denominator << size)
    for i in range(d):
        a[i, i] -= shift
    order = list(range(d))
    for k in range(d):  # rows in place, multipliers below the diagonal
        i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
            order[i], order[k] = order[k], order[i]
        if not a[k, k]:
            a[k, k] = 1  # singular to the last bit: as near to it as the numbers go
        if k + 1 < d:
            share = (a[k + 1:, k] << bits) // a[k, k]
            a[k + 1:, k + 1:] -= (share[:, None] * a[k, k + 1:][None, :]) >> bits
            a[k + 1:, k] = share
    dice = random.Random(d)
    vectors = [np.array([dice.randrange(-1 << 32, 1 << 32) << (bits - 32) for _ in range(d)], object)
               for _ in range(count)]
    for _ in range(3):
        solved = []
        for v in vectors:
            x = v[order]
            for k in range(d - 1):
                x[k + 1:] -= (a[k + 1:, k] * x[k]) >> bits
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] << bits) // a[k, k]
                x[:k] -= (a[:k, k] * x[k]) >> bits
            for _ in range(2):  # twice is enough
                x = _unit(x, bits)
                for w in solved:
                    x = x - ((int((x * w).sum()) * w) >> (2 * bits))
            solved.append(_unit(x, bits))
        vectors = solved
    out = np.array([[float(Fraction(int(x), 1 << bits)) for x in v] for v in vectors])
    sign = np.sign(out[np.arange(count), np.abs(out).argmax(axis=1)])
    return out * sign[:, None]


def _unit(x: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int((x * x).sum()))
    return (x << bits) // length
