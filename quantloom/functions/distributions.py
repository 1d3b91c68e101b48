"""Distribution functions in numpy: normal, Student t, F, chi-square.

The incomplete beta function is evaluated by its continued fraction (Lentz's method), the
incomplete gamma function by series or fraction, on whole arrays.
"""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])
TINY = 1e-300


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(z, float) / math.sqrt(2)))


def normal_pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.asarray(z, float) ** 2) / math.sqrt(2 * math.pi)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function; NaN where an argument is NaN."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    a, b, x = a[ok], b[ok], np.clip(x[ok], 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p if len(y) else y
    value = np.where(y <= 0, 0.0, front * _fraction(p, q, y))
    out[ok] = np.where(swap, 1 - value, value)
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_upper(x: float, k: float) -> float:
    """Upper tail of chi-square."""
    a, y = k / 2, max(x, 0.0) / 2
    if y == 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= y / (a + n)
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return 1 - front * total
    b, c = y + 1 - a, 1 / TINY
    d = h = 1 / b
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
