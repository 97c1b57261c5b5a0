"""Probabilities of test statistics, in numpy: normal, chi-square, t, F and non-central F."""

from __future__ import annotations

import math

import numpy as np


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function: a series below 2.5, else a continued fraction; relative error about 1e-13."""
    x = np.asarray(x, float)
    a = np.abs(x)
    small, t = np.zeros_like(a), np.minimum(a, 2.5)
    term = t.copy()
    for n in range(1, 80):
        small, term = small + term, term * t * t * 2 / (2 * n + 1)
    low = 1 - 2 / math.sqrt(math.pi) * np.exp(-t * t) * small
    b = np.maximum(a, 2.5)
    f = np.zeros_like(b)
    for k in range(80, 0, -1):
        f = k / 2 / (b + f)
    high = np.exp(-b * b) / math.sqrt(math.pi) / (b + f)
    out = np.where(a < 2.5, low, high)
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - out, out))


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return erfc(np.abs(z) / math.sqrt(2))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(2000):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or 1e-300)
        c = (1 + n / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return math.nan if math.isnan(t) else betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, a: float, b: float) -> float:
    """P(F > f) with a and b degrees of freedom."""
    return 1.0 if f <= 0 else betainc(b / 2, a / 2, b / (b + a * f))


def noncentral_f_sf(f: float, a: float, b: float, lam: float) -> float:
    """P(F > f) of the non-central F distribution, as a Poisson mixture of incomplete beta functions."""
    if f <= 0:
        return 1.0
    x, h = a * f / (a * f + b), lam / 2
    mode = int(h)
    total = 0.0
    for step in (1, -1):
        j = mode if step == 1 else mode - 1
        while j >= 0:
            w = math.exp(-h + (j * math.log(h) if h > 0 else 0.0 if j == 0 else -math.inf) - math.lgamma(j + 1))
            total += w * betainc(a / 2 + j, b / 2, x)
            if w < 1e-17:
                break
            j += step
    return max(0.0, 1 - total)


def chi2_sf(x: float, k: float) -> float:
    """P(X > x) of chi-square with k degrees of freedom, by the incomplete gamma function."""
    s, t = k / 2, x / 2
    if t <= 0:
        return 1.0
    front = math.exp(-t + s * math.log(t) - math.lgamma(s))
    if t < s + 1:
        term = total = 1 / s
        n = s
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= t / n
            total += term
        return 1 - front * total
    f = 0.0
    for k_ in range(400, 0, -1):
        f = k_ * (k_ - s) / (2 * k_ + 1 + t - s - f)
    return front / (t + 1 - s - f)
