"""Vectorised discrete distributions used inside Arrow batches.

Spark has no log-gamma and SciPy is not required, so log-factorials come from
the Stirling series (exact products below 16).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_SMALL = np.array([math.lgamma(i) if i > 0 else 0.0 for i in range(18)])


def log_gamma(x) -> np.ndarray:
    """log Γ(x) for x > 0, by array."""
    x = np.asarray(x, dtype=float)
    shift = np.where(x < 16, 16 - np.floor(x), 0.0)
    y = x + shift
    inv = 1.0 / y
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    for step in range(16):
        live = shift > step
        if not live.any():
            break
        out = out - np.where(live, np.log(np.where(live, x + step, 1.0)), 0.0)
    whole = (x == np.floor(x)) & (x < 18)
    return np.where(whole, _SMALL[np.where(whole, x, 0).astype(int)], out)


def poisson_pmf(k, mu: float) -> np.ndarray:
    k = np.asarray(k, dtype=float)
    if mu <= 0:
        return (k == 0).astype(float)
    return np.exp(k * math.log(mu) - mu - log_gamma(k + 1))


def neg_binomial_pmf(k, size: float, mean: float) -> np.ndarray:
    """Negative binomial by its mean: success probability size / (size + mean)."""
    k = np.asarray(k, dtype=float)
    p = size / (size + mean)
    body = log_gamma(k + size) - log_gamma(size) - log_gamma(k + 1) + size * math.log(p)
    return np.exp(body + np.where(k > 0, k * math.log1p(-p) if p < 1 else -np.inf, 0.0))


def incomplete_beta(x, a, b) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, by array; a, b > 0.

    The fraction is evaluated on the side of the mean where it converges in about sqrt(max(a, b)) steps, all
    parameter sets together, those that have settled leaving the loop.
    """
    x, a, b = (v.astype(float) for v in np.broadcast_arrays(x, a, b))
    shape = x.shape
    x, a, b = x.ravel(), a.ravel(), b.ravel()
    out = np.where(x >= 1, 1.0, 0.0)
    inside = np.flatnonzero((x > 0) & (x < 1))
    x, a, b = x[inside], a[inside], b[inside]
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    value = np.ones(len(x))
    live = np.arange(len(x))
    c, d = np.ones(len(x)), 1 / _off_zero(1 - (a + b) * x / (a + 1))
    h = d.copy()
    m = 0
    while len(live):
        m += 1
        u, p, q = x[live], a[live], b[live]
        for step in (m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _off_zero(1 + step * d)
            c = _off_zero(1 + step / c)
            h = h * c * d
        # a not-a-number never settles by itself
        settled = ~(np.abs(c * d - 1) >= 1e-15)
        value[live[settled]] = h[settled]
        live, c, d, h = live[~settled], c[~settled], d[~settled], h[~settled]
        if m >= 100_000:
            raise ArithmeticError("the continued fraction of the incomplete beta function does not settle")
    part = front * value / a
    out[inside] = np.where(flip, 1 - part, part)
    return out.reshape(shape)


def _off_zero(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def binomial_cdf(k, n, p) -> np.ndarray:
    """P(X ≤ k) of n trials, by array; 0 <= p <= 1."""
    k, n, p = (np.asarray(v, dtype=float) for v in (k, n, p))
    tail = incomplete_beta(1 - p, np.maximum(n - k, 1e-9), np.maximum(k + 1, 1e-9))
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, tail))


def binomial_quantile(q, n, p) -> np.ndarray:
    """Smallest k with P(X ≤ k) ≥ q, by array: bisection on the distribution function, never a walk along it."""
    q, n, p = (v.astype(float) for v in np.broadcast_arrays(q, n, p))
    high = np.where((n <= 0) | (p <= 0), 0.0, np.floor(n))
    low = np.where(p >= 1, high, -1.0)
    # invariant: the distribution function is below q at low and not below it at high
    p = np.clip(p, 0.0, 1.0)
    while (high - low > 1).any():
        middle = np.floor((low + high) / 2)
        reached = binomial_cdf(middle, n, p) >= q - 1e-13
        high, low = np.where(reached & (high - low > 1), middle, high), np.where(reached | (high - low <= 1), low, middle)
    return high.astype(np.int64)


def _choose(n, m) -> np.ndarray:
    return log_gamma(n + 1.0) - log_gamma(m + 1.0) - log_gamma(n - m + 1.0)


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """Two-sided Fisher p of 2x2 tables, by array: all tables no more likely than the seen one (relative slack 1e-7).

    The probabilities rise to one mode and fall after it. The far tail's first table is found by bisection, and
    both tails are summed outwards from ratios of neighbours until nothing is added: about as many steps as the
    standard deviation, not as the margin.
    """
    a, b, c, d = (np.atleast_1d(np.asarray(v, dtype=np.int64)) for v in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    lo, hi = np.maximum(0, c1 - r2), np.minimum(r1, c1)
    mode = np.clip((r1 + 1) * (c1 + 1) // (r1 + r2 + 2), lo, hi)
    weight = lambda k: _choose(r1, k) + _choose(r2, c1 - k) - _choose(r1 + r2, c1)
    limit = weight(a) + 1e-7

    def edge(outer: np.ndarray, way: int) -> np.ndarray:
        """The table nearest the mode, on the ``way`` from ``outer``, that is within the limit; one beyond ``outer`` if none."""
        far = np.abs(mode - outer) + 1
        within = weight(outer) <= limit
        inside, beyond = np.where(within, 0, -1), np.where(within, far, 0)
        while (beyond - inside > 1).any():
            middle = (inside + beyond) // 2
            ok = weight(np.clip(outer + way * middle, lo, hi)) <= limit
            wide = beyond - inside > 1
            inside, beyond = np.where(wide & ok, middle, inside), np.where(wide & ~ok, middle, beyond)
        return outer + way * inside

    left, right = edge(lo, 1), edge(hi, -1)
    total = np.zeros(len(a))
    for k, way, end in ((left, -1, lo), (right, 1, hi)):
        live = (k >= lo) & (k <= hi)
        term = np.where(live, np.exp(weight(np.clip(k, lo, hi))), 0.0)
        k = k.copy()
        while live.any():
            total += np.where(live, term, 0.0)
            live &= (k != end) & (term > total * 1e-18)
            up = (r1 - k) * (c1 - k) / np.maximum((k + 1.0) * (r2 - c1 + k + 1), 1)
            down = k * (r2 - c1 + k) / np.maximum((r1 - k + 1.0) * (c1 - k + 1), 1)
            term = term * (up if way > 0 else down)
            k = np.where(live, k + way, k)
    return np.where(left + 1 >= right, 1.0, np.minimum(total, 1.0))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided(a, b, c, d), dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))
