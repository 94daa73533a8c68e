"""Special functions over numpy arrays, for an environment without a numerics library."""

from __future__ import annotations

import math

import numpy as np

#: Bernoulli numbers B2, B4, ... of the asymptotic series.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)
_SHIFT = 10


def _raised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arguments moved to _SHIFT or more, and the steps (last axis) that were passed on the way."""
    x = np.asarray(x, dtype=np.float64)
    steps = x[..., None] + np.arange(_SHIFT)
    low = x < _SHIFT
    return np.where(low, x + _SHIFT, x), np.where(low[..., None], steps, np.inf)


def log_gamma(x: np.ndarray) -> np.ndarray:
    y, steps = _raised(x)
    series = sum(b / (2 * k * (2 * k - 1) * y ** (2 * k - 1)) for k, b in enumerate(BERNOULLI, 1))
    passed = np.log(np.where(np.isinf(steps), 1.0, steps)).sum(axis=-1)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - passed


def digamma(x: np.ndarray) -> np.ndarray:
    y, steps = _raised(x)
    return np.log(y) - 0.5 / y - sum(b / (2 * k * y ** (2 * k)) for k, b in enumerate(BERNOULLI, 1)) - (1.0 / steps).sum(axis=-1)


def trigamma(x: np.ndarray) -> np.ndarray:
    y, steps = _raised(x)
    return 1 / y + 0.5 / y**2 + sum(b / y ** (2 * k + 1) for k, b in enumerate(BERNOULLI, 1)) + (1.0 / steps**2).sum(axis=-1)


def chi_square_tail(stat: float, df: float) -> float:
    """P(X > stat) of a chi-square variable: the upper regularised incomplete gamma function."""
    if df <= 0 or not stat > 0:
        return 1.0
    a, x = df / 2, stat / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a)) if x < 700 else 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, max(0.0, 1 - total * scale))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or tiny)
        c = b + n / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, max(0.0, out * scale))


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """Two-sided p values of normal scores."""
    return np.array([min(1.0, math.erfc(abs(v) / math.sqrt(2))) for v in np.asarray(z, dtype=np.float64)])
