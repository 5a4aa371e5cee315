"""Special functions from published series and continued fractions, for numpy arrays and scalars."""

from __future__ import annotations

import math

import numpy as np


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: the power series below a + 1, the continued fraction above it."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    return 1 - _gamma_tail(a, x, front)


def _gamma_tail(a: float, x: float, front: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b or tiny
        c = b + an / c or tiny
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def gammaincc(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1 - gammainc(a, x)
    return _gamma_tail(a, x, math.exp(-x + a * math.log(x) - math.lgamma(a)))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def ndtr(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def ndtri(p: float) -> float:
    """Inverse normal: a rational start (Hastings), then Halley steps on the error function."""
    if not 0 < p < 1:
        return math.inf if p == 1 else -math.inf if p == 0 else math.nan
    q = min(p, 1 - p)
    t = math.sqrt(-2 * math.log(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    for _ in range(4):
        e = 0.5 * math.erfc(z / math.sqrt(2)) - q
        u = e * math.sqrt(2 * math.pi) * math.exp(z * z / 2)
        z += u / (1 - z * u / 2)
    return z if p > 0.5 else -z if p < 0.5 else 0.0


def bisect(cdf, target: float, low: float, high: float, tolerance: float = 1e-13, steps: int = 300) -> float:
    """x with cdf(x) = target for a rising cdf; the bracket grows until it holds the target."""
    while cdf(low) > target:
        low, high = low - 2 * (high - low), low
    while cdf(high) < target:
        low, high = high, high + 2 * (high - low)
    for _ in range(steps):
        mid = (low + high) / 2
        if cdf(mid) < target:
            low = mid
        else:
            high = mid
        if high - low <= tolerance * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def kolmogorov_sf(x: float) -> float:
    """Tail of the limit distribution of sqrt(n) times the largest deviation."""
    if x <= 0:
        return 1.0
    if x < 1:
        k = np.arange(1, 50)
        return float(1 - math.sqrt(2 * math.pi) / x * np.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)).sum())
    k = np.arange(1, 101)
    return float(max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum()))


def smirnov_sf(d: float, n: int) -> float:
    """Exact one-sided one-sample tail (Birnbaum and Tingey)."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    j = np.arange(0, int(math.floor(n * (1 - d))) + 1)
    u, v = 1 - d - j / n, d + j / n
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in j])
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = log_choose + np.where(n - j > 0, (n - j) * np.log(np.maximum(u, 0)), 0) + (j - 1) * np.log(v)
    return float(min(1.0, max(0.0, d * np.exp(logs).sum())))


def two_sample_one_sided_sf(d: float, n1: int, n2: int) -> float:
    """Hodges' approximation of the one-sided two-sample tail."""
    m, n = max(n1, n2), min(n1, n2)
    z = math.sqrt(m * n / (m + n)) * d
    return float(min(1.0, math.exp(-2 * z * z - 2 * z * (m + 2 * n) / math.sqrt(m * n * (m + n)) / 3)))
