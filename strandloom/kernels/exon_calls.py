"""Sub-exons of a gene refined by its read coverage."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

Span = tuple[int, int]


@dataclass(frozen=True)
class RefineSettings:
    """Shares of the peak that make an exon and a splice site, the derivative's z score, and fixed lengths in bases."""

    exon_share: float = 0.02
    splice_share: float = 0.02
    z_score: float = 10.0
    least_depth: float = 20.0
    least_length: int = 20
    hole: int = 20
    spacing: int = 10
    snap: int = 20


def depth_of(start: int, end: int, blocks: np.ndarray) -> np.ndarray:
    """Depth over [start, end) of aligned blocks (k x 2) that lie inside it."""
    change = np.zeros(end - start + 1, dtype=np.int64)
    inside = (blocks[:, 0] >= start) & (blocks[:, 1] <= end)
    np.add.at(change, blocks[inside, 0] - start, 1)
    np.add.at(change, blocks[inside, 1] - start, -1)
    return np.cumsum(change)[:-1]


def deep_stretches(depth: np.ndarray, start: int, settings: RefineSettings) -> list[Span]:
    """Stretches deeper than the floor and long enough, small holes between them filled."""
    if not len(depth) or depth.max() <= 0:
        return []
    edges = np.diff(np.concatenate(([0], (depth > max(depth.max() * settings.exon_share, settings.least_depth)).astype(np.int8), [0])))
    runs = [(int(a) + start, int(b) + start) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True) if b - a >= settings.least_length]
    out: list[Span] = []
    for a, b in runs:
        if out and a - out[-1][1] <= settings.hole:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _between(spans: list[Span], cuts: list[int], spacing: int) -> list[Span]:
    """Spans cut at the places that lie further than ``spacing`` inside them."""
    out = []
    for a, b in spans:
        points = [a, *(c for c in cuts if c - a > spacing and b - c > spacing), b]
        out += [(x, y) for x, y in zip(points, points[1:], strict=False) if y > x]
    return out


def at_splice_sites(spans: list[Span], junctions: list[Span], settings: RefineSettings) -> list[Span]:
    """Spans cut at splice sites that enough reads use; of sites close together the most used stays."""
    used = Counter(p for j in junctions for p in j)
    if len(used) <= 1:
        return spans
    floor = max(max(used.values()) * settings.splice_share, settings.least_depth)
    out = []
    for a, b in spans:
        left = sorted((p for p, n in used.items() if n >= floor and a < p < b), key=lambda p: (-used[p], p))
        kept: list[int] = []
        while left:
            kept.append(left[0])
            left = [p for p in left if abs(p - kept[-1]) > settings.spacing]
        out += _between([(a, b)], sorted(kept), settings.spacing)
    return out


def smoothed(values: np.ndarray) -> np.ndarray:
    """A Gaussian of width 1 over 4 neighbours either side, the ends mirrored without repeating them."""
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    at = np.arange(-4, len(values) + 4)
    period = max(1, 2 * (len(values) - 1))
    at = at % period
    at = np.where(at >= len(values), period - at, at)
    return np.convolve(values[at], kernel / kernel.sum(), mode="valid")


def at_steps(spans: list[Span], depth: np.ndarray, start: int, settings: RefineSettings) -> list[Span]:
    """Spans cut where the smoothed depth's derivative stands out among all of the gene's."""
    places, steps = [], []
    for a, b in spans:
        if b - a >= 2:
            at = np.arange(a, b) - start
            series = np.where(at < len(depth), depth[np.minimum(at, len(depth) - 1)], 0).astype(np.float64)
            steps.append(np.diff(smoothed(series)))
            places.append(np.arange(a + 1, b))
    if not steps:
        return spans
    all_steps, all_places = np.concatenate(steps), np.concatenate(places)
    spread = all_steps.std()
    if spread == 0:
        return spans
    kept: list[int] = []
    for p in all_places[np.abs((all_steps - all_steps.mean()) / spread) > settings.z_score].tolist():
        if not kept or p - kept[-1] > settings.spacing:
            kept.append(p)
    return _between(spans, kept, settings.spacing)


def called_exons(start: int, depth: np.ndarray, junctions: list[Span], settings: RefineSettings = RefineSettings()) -> list[Span]:
    return at_steps(at_splice_sites(deep_stretches(depth, start, settings), junctions, settings), depth, start, settings)


def updated_exons(called: list[Span], known: list[Span], settings: RefineSettings = RefineSettings()) -> list[Span]:
    """Known sub-exons partitioned by called ones, whose ends are first moved to known ends close by. Single sub-exons stay."""
    if not called or len(known) == 1:
        return known
    ends = [p for k in known for p in k]

    def moved(p: int) -> int:
        best = min(ends, key=lambda q: abs(p - q))
        return best if abs(p - best) < settings.snap else p

    spans = [(moved(a), moved(b)) for a, b in called]
    spans = sorted([s for s in spans if s[1] > s[0]] + known)
    points = sorted({p for s in spans for p in s})
    return [(a, b) for a, b in zip(points, points[1:], strict=False) if any(s[0] <= a and b <= s[1] for s in spans)]


def remapped(rows: list[list[int]], old: list[Span], new: list[Span]) -> list[list[int]]:
    """Isoforms over new sub-exons: those inside their old ones; isoforms left without any go, the longest come first."""
    out = []
    for row in rows:
        inside = sorted({k for i in row if i < len(old) for k, (a, b) in enumerate(new) if old[i][0] <= a and b <= old[i][1]})
        if inside:
            out.append(inside)
    return sorted(out, key=lambda r: -len(r))
