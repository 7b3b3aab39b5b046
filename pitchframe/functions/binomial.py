"""Binomial quantiles on arrays, for draws that can be repeated from uniform numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_normal = np.vectorize(NormalDist().inv_cdf, otypes=[float])
TINY = 1e-300
EXACT_VARIANCE = 10_000.0  # above it the Cornish-Fisher expansion replaces the search


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function; converges within some square roots of the larger parameter."""
    safe = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    steps = 200 + int(8 * math.sqrt(float(max(a.max(initial=1), b.max(initial=1)))))
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = np.ones_like(x)
        for term in (even, odd):
            d, c = 1 / safe(1 + term * d), safe(1 + term / c)
            change = change * d * c
        out *= change
        if np.all(np.abs(change - 1) < 1e-15):
            break
    return out


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) of a binomial with ``n`` trials of probability ``p``."""
    out = np.where(k < 0, 0.0, 1.0)
    open_ = (k >= 0) & (k < n) & (p > 0) & (p < 1)
    out = np.where((k >= 0) & (k < n) & (p >= 1), 0.0, out)
    if open_.any():
        k, n, p = (v[open_].astype(float) for v in (k, n, p))
        a, b, x = n - k, k + 1, 1 - p
        front = np.exp(_lgamma(n + 1) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log(p))
        direct = x < (a + 1) / (a + b + 2)
        value = np.empty_like(x)
        if direct.any():
            value[direct] = front[direct] * _fraction(a[direct], b[direct], x[direct]) / a[direct]
        if not direct.all():
            o = ~direct
            value[o] = 1 - front[o] * _fraction(b[o], a[o], 1 - x[o]) / b[o]
        out[open_] = value
    return out


def _expanded(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The quantile by Cornish-Fisher expansion to the second order, with continuity correction."""
    spread, z = np.sqrt(n * p * (1 - p)), _normal(np.clip(u, 1e-16, 1 - 1e-16))
    skew, excess = (1 - 2 * p) / spread, (1 - 6 * p * (1 - p)) / spread**2
    w = z + skew * (z**2 - 1) / 6 + excess * (z**3 - 3 * z) / 24 - skew**2 * (2 * z**3 - 5 * z) / 36
    return np.clip(np.ceil(n * p + spread * w - 0.5), 0, n).astype(np.int64)


def _searched(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The quantile by bisection between bounds that widen until they hold it."""
    spread = np.sqrt(np.maximum(n * p * (1 - p), 0))
    guess = np.floor(n * p + spread * _normal(np.clip(u, 1e-16, 1 - 1e-16)))
    width = np.maximum(2, 0.1 * spread).astype(np.int64)
    low, high = np.clip(guess - width, -1, n).astype(np.int64), np.clip(guess + width, 0, n).astype(np.int64)
    step = width.copy()
    while (far := (low >= 0) & (binomial_cdf(low, n, p) >= u)).any():
        low, step = np.where(far, np.maximum(low - step, -1), low), step * 2
    step = width.copy()
    while (far := (high < n) & (binomial_cdf(high, n, p) < u)).any():
        high, step = np.where(far, np.minimum(high + step, n), high), step * 2
    while (open_ := high - low > 1).any():
        middle = (low + high) // 2
        enough = binomial_cdf(middle, n, p) >= u
        high, low = np.where(open_ & enough, middle, high), np.where(open_ & ~enough, middle, low)
    return high


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) >= u.

    Exact up to a variance of ``EXACT_VARIANCE``; beyond that an expansion whose
    probability is off by less than a millionth, at a cost that no longer grows.
    """
    u, n, p = (v.copy() for v in np.broadcast_arrays(np.asarray(u, float), np.asarray(n, np.int64), np.asarray(p, float)))
    wide = n * p * (1 - p) > EXACT_VARIANCE
    out = np.empty(len(u), np.int64)
    for part, rule in ((wide, _expanded), (~wide, _searched)):
        if part.any():
            out[part] = rule(u[part], n[part], p[part])
    return out


def multinomial_counts(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Counts per class (rows of ``p``) of ``n`` trials as a chain of binomials, one uniform number per class but the last."""
    classes = p.shape[1]
    out, left, rest = np.zeros(p.shape, np.int64), np.asarray(n, np.int64).copy(), p.sum(axis=1)
    for k in range(classes - 1):
        share = np.clip(np.divide(p[:, k], rest, out=np.zeros(len(rest)), where=rest > 0), 0, 1)
        out[:, k] = binomial_quantile(u[:, k], left, share)
        left, rest = left - out[:, k], rest - p[:, k]
    out[:, -1] = left
    return out
