"""Distribution functions and tests on small aggregates, on the driver; no more than the standard library and numpy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, h * scale)


def chi2_sf(x: float, dof: int) -> float:
    return _gamma_q(dof / 2, x / 2) if dof > 0 else 1.0


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * h)


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def sign_test(positive: int, negative: int) -> float:
    """Exact two-sided binomial test of one half."""
    n, k = positive + negative, min(positive, negative)
    return 1.0 if not n else min(1.0, 2 * (1 - binom_sf(k + 1, n, 0.5)))


def t_quantile(p: float, dof: float) -> float:
    def cdf(t):
        tail = 0.5 * beta_inc(dof / 2, 0.5, dof / (dof + t * t))
        return 1 - tail if t > 0 else tail

    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def wilson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Interval of a share; exactly 0 and 1 at the ends."""
    if n <= 0:
        return 0.0, 1.0
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p, zz = k / n, z * z / n
    mid, half = (p + zz / 2) / (1 + zz), z * math.sqrt(p * (1 - p) / n + zz / (4 * n)) / (1 + zz)
    return 0.0 if k == 0 else max(0.0, mid - half), 1.0 if k == n else min(1.0, mid + half)


def contingency(table) -> tuple[float, float, int]:
    """Chi-square, its p-value and degrees of freedom; with one degree Yates' correction holds."""
    x = np.asarray(table, float)
    x = x[x.sum(axis=1) > 0][:, x.sum(axis=0) > 0]
    dof = (x.shape[0] - 1) * (x.shape[1] - 1) if x.size else 0
    if dof < 1:
        return 0.0, 1.0, 0
    expected = np.outer(x.sum(axis=1), x.sum(axis=0)) / x.sum()
    gap = np.abs(x - expected)
    if dof == 1:
        gap = gap - np.minimum(0.5, gap)
    chi = float((gap**2 / expected).sum())
    return chi, chi2_sf(chi, dof), dof


def cramers_v(chi: float, n: float) -> float:
    return math.sqrt(chi / n) if n else 0.0


def ks_sf(statistic: float, n: int, m: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value from the limiting distribution, with its small-sample correction."""
    if not n or not m:
        return 1.0
    e = math.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * statistic
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def jensen_shannon(p, q) -> float:
    """Divergence in bits of two distributions given as counts."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return (part(p) + part(q)) / 2


def wilcoxon_p(w_plus: float, n: int, ties: float) -> float:
    """Signed-rank p-value by the normal approximation; ``ties`` is the sum of t**3 - t over groups of equal ranks."""
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if var <= 0 else min(1.0, 2 * normal_sf(abs(w_plus - mean) / math.sqrt(var)))
