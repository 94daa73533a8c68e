"""Change points of a coverage series: recursive splits in single precision, as the output contract wants."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: The polynomial approximation of erfc (error below 1.5e-7) that the p values are defined by.
ERFC = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


@dataclass(frozen=True)
class ChangePoint:
    pos: int
    start: int
    end: int
    p: float
    ratio: float
    sign: int


def average_ranks(values: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2.0)[inverse]


def approximate_erfc(x: float) -> float:
    if x < 0:
        return 2.0 - approximate_erfc(-x)
    scale, *coefficients = ERFC
    t = 1.0 / (1.0 + scale * x)
    total = 0.0
    for c in reversed(coefficients):
        total = t * (c + total)
    return total * math.exp(-x * x)


def rank_test(left: np.ndarray, right: np.ndarray) -> float:
    """Two-sided Mann-Whitney p by the larger U with continuity correction; 1 where there is nothing to tell apart."""
    n1, n2 = len(left), len(right)
    if not n1 or not n2:
        return 1.0
    both = np.concatenate((left, right)).astype(np.float64)
    _, ties = np.unique(both, return_counts=True)
    n = float(n1 + n2)
    correction = 1.0 - float((ties.astype(np.float64) ** 3 - ties).sum()) / (n**3 - n)
    if correction == 0.0:
        return 1.0
    u = n1 * n2 + n1 * (n1 + 1) / 2.0 - float(average_ranks(both)[:n1].sum())
    spread = math.sqrt(correction * n1 * n2 * (n + 1) / 12.0)
    return approximate_erfc(abs(max(u, n1 * n2 - u) - (n1 * n2 / 2.0 + 0.5)) / spread / math.sqrt(2.0))


def best_split(values: np.ndarray) -> int:
    """First split with the least squared error around both sides' means, in float32; -1 for fewer than two values."""
    n = len(values)
    if n < 2:
        return -1
    x = values.astype(np.float32)
    whole = _in_order(x)
    left = np.cumsum(x, dtype=np.float32)
    right = np.subtract.accumulate(np.concatenate(([whole], x)), dtype=np.float32)[1:]
    best, at = np.float32(0), -1
    for i in range(1, n):
        error = _in_order(np.concatenate(((x[:i] - left[i - 1] / np.float32(i)) ** 2, (x[i:] - right[i - 1] / np.float32(n - i)) ** 2)))
        if at < 0 or error < best:
            best, at = error, i
    return at


def _in_order(x: np.ndarray) -> np.float32:
    """The float32 sum from left to right (numpy's own sum adds pairwise)."""
    return np.cumsum(x, dtype=np.float32)[-1] if len(x) else np.float32(0)


def smooth(values: np.ndarray, window: int) -> np.ndarray:
    """Hanning-smoothed series over reflected ends, one element longer than the input."""
    k = window - 1
    weights = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / k) if window > 1 else np.ones(window)
    x = values.astype(np.float64)
    signal = np.concatenate((x[k:0:-1], x, x[len(x) - k :][::-1]))
    full = np.convolve(signal, weights / weights.sum(), mode="valid")
    return full[window // 2 - 1 : len(full) - window // 2]


def slopes(smoothed: np.ndarray) -> np.ndarray:
    return np.gradient(smoothed) if len(smoothed) > 1 else np.zeros(len(smoothed))


def same_sign_run(slope: np.ndarray, at: int) -> tuple[int, int, int]:
    """Steps left and right (both with the point) over which the slope keeps its sign, and the sign; zeros for a flat point."""
    sign = np.sign(slope)
    own = int(sign[at])
    if not own:
        return 0, 0, 0
    other_left = np.flatnonzero(sign[: at + 1][::-1] != own)
    other_right = np.flatnonzero(sign[at:] != own)
    return int(other_left[0]) if len(other_left) else at + 1, int(other_right[0]) if len(other_right) else len(sign) - at, own


def change_points(values: np.ndarray, *, p: float = 0.01, fold: float = 0.85, least: int = 20, window: int = 75) -> list[ChangePoint]:
    """Points where coverage changes level, in the order of the recursion (a point before those left, then right, of it)."""
    x = np.asarray(values, dtype=np.float32)
    if len(x) < window:
        return []
    slope: np.ndarray | None = None  # smoothed only where a point passes the tests
    found: list[ChangePoint] = []
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        part = x[a:b]
        if len(part) < least:
            continue
        steps = np.flatnonzero(np.diff(part))
        short = part[steps]
        split = best_split(short)
        if split < 0 or steps[split] <= 1:
            continue
        i = int(steps[split])
        means = sorted(_in_order(y) / np.float32(len(y)) for y in (part[:i], part[i:]))
        ratio = float(means[0] / means[1]) if means[1] else math.nan
        if ratio >= fold:
            continue
        score = rank_test(short[:split], short[split:])
        if score >= p:
            continue
        if slope is None:
            slope = slopes(smooth(x, window))
        left, right, sign = same_sign_run(slope, a + i)
        if not left or not right:
            continue
        found.append(ChangePoint(a + i, a + i - left, a + i + right, score, ratio, sign))
        if a + i + right < b:
            todo.append((a + i + right, b))
        if i > left:
            todo.append((a, a + i - left))
    return found


def zero_crossings(values: np.ndarray, start: int) -> list[int]:
    """Positions where coverage begins or ends."""
    on = np.asarray(values) > 0
    return (np.flatnonzero(on[1:] != on[:-1]) + 1 + start).tolist()
