"""Transcript ends from counted read ends, and groups of unspliced reads."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class PeakSettings:
    """``window``: reach of a peak; ``support``: share (below 1) or reads that must remain; ``rule``: none, longest, best_only."""

    window: int = 100
    results: int = 2
    support: float = 0.25
    per_isoform: bool = False
    rule: str = "none"


def best_peak(positions: np.ndarray, counts: np.ndarray, window: int, *, first: bool) -> int:
    """Index of the position with the most weight, near reads counting less with distance; the first (or last) position on ties."""
    weight = np.empty(len(positions))
    for at in range(0, len(positions), 256):  # a slice of the matrix of distances at a time
        distance = np.abs(positions[at : at + 256, None] - positions[None, :])
        weight[at : at + 256] = (np.where(distance < window, (window - distance) / window, 0.0) * counts).sum(axis=1)
    return int(np.argmax(weight)) if first else len(weight) - 1 - int(np.argmax(weight[::-1]))


def snapped(pos: int, known: set[int], window: int, *, below: float | None = None, above: float | None = None) -> int:
    """The nearest annotated end in [pos - window, pos + window) on the right side of the junctions, the lower on ties; else ``pos``."""
    near = [t for t in range(pos - window, pos + window) if t in known and (below is None or t < below) and (above is None or t > above)]
    return min(near, key=lambda t: (abs(t - pos), t), default=pos)


def peaks(sites: Counter[int], total: int, settings: PeakSettings, *, first: bool, results: int, known: set[int], side: float) -> list[tuple[int, int]]:
    """(end, reads at the peak) of the strongest peaks, one after the other, each taking the reads within the window along.

    A further peak needs its share of all reads, four reads of its own and an average site's worth.
    """
    positions = np.array(sorted(sites), dtype=np.int64)
    counts = np.array([sites[p] for p in positions.tolist()], dtype=np.float64)
    average = counts.sum() / max(1, len(counts))
    share = settings.support < 1
    found: list[tuple[int, int]] = []
    while len(positions) and len(found) < results:
        remaining = counts.sum()
        if not (share and remaining / total > settings.support or remaining >= settings.support):
            break
        at = best_peak(positions, counts, settings.window, first=first)
        pos, own = int(positions[at]), int(counts[at])
        left = np.abs(positions - pos) > settings.window
        used = remaining - counts[left].sum()
        if found and (settings.rule == "best_only" or share and (used / total < settings.support or own < 4 or used < average)):
            break
        found.append((snapped(pos, known, settings.window, below=side if first else None, above=None if first else side), own))
        positions, counts = positions[left], counts[left]
    return found


def end_pairs(ends: Counter[tuple[int, int]], settings: PeakSettings, *, results: int, starts_known: set[int], ends_known: set[int], junctions: tuple[float, float]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, support, reads at start, reads at end): for each start peak the peaks of the ends seen near it."""
    total = sum(ends.values())
    by_start: Counter[int] = Counter()
    for (start, _), n in ends.items():
        by_start[start] += n
    out = []
    for start, n_start in peaks(by_start, total, settings, first=True, results=results, known=starts_known, side=junctions[0]):
        near: Counter[int] = Counter()
        for (s, e), n in ends.items():
            if abs(s - start) <= settings.window:
                near[e] += n
        for end, n_end in peaks(near, total, settings, first=False, results=results, known=ends_known, side=junctions[1]):
            out.append((start, end, max(n_start, n_end), n_start, n_end))
    return out


def chain_ends(ends: Counter[tuple[int, int]], settings: PeakSettings, *, starts_known: set[int] = frozenset(), ends_known: set[int] = frozenset(), junctions: tuple[float, float]) -> list[tuple[int, int, float]]:
    """(start, end, support) of a chain's isoforms under the redundancy rule."""
    found = end_pairs(ends, settings, results=settings.results, starts_known=starts_known, ends_known=ends_known, junctions=junctions)
    if not found:
        return []
    if settings.per_isoform and settings.rule == "longest":
        start, end = min(f[0] for f in found), max(f[1] for f in found)
        return [(start, end, (next(f[3] for f in found if f[0] == start) + next(f[4] for f in found if f[1] == end)) / 2)]
    if settings.per_isoform and settings.rule == "best_only":
        return [(found[0][0], found[0][1], found[0][3])]
    return [f[:3] for f in (found[:1] if settings.rule == "longest" else found)]


def renamed(name: str, k: int) -> str:
    """``-k`` before the last underscore."""
    head, mark, tail = name.rpartition("_")
    return f"{head}-{k}{mark}{tail}" if mark else f"{name}-{k}"


@dataclass
class ReadGroup:
    """Unspliced reads around running mean bounds."""

    name: str
    low: float
    high: float
    weight: float = 0.0
    ends: Counter[tuple[int, int]] = field(default_factory=Counter)
    strands: Counter[str] = field(default_factory=Counter)

    def overlap(self, start: int, end: int) -> float | None:
        """Share of the leftmost interval that the other covers; None where they do not meet."""
        (a, b), (c, d) = sorted([(float(start), float(end)), (self.low, self.high)], key=lambda x: x[0])
        if not a <= c <= b:
            return None
        return (min(b, d) - c) / (b - a) if b != a else 0.0

    def add(self, start: int, end: int, n: int, strand: str) -> None:
        self.weight += n
        self.low += n * (start - self.low) / self.weight
        self.high += n * (end - self.high) / self.weight
        self.ends[start, end] += n
        self.strands[strand] += 1


def group_reads(reads: list[tuple[int, int, int, str, str]], window: int, back: int = 7) -> list[ReadGroup]:
    """Groups of (start, end, n, name, strand) rows sorted by place.

    A read looks at the last groups, newest first, up to the first that it does not meet, and joins
    the best covered one that it does not outreach.
    """
    groups: list[ReadGroup] = []
    for start, end, n, name, strand in reads:
        met = []
        for group in reversed(groups[-back:]):
            share = group.overlap(start, end)
            if share is None:
                break
            met.append((share, group))
        for _, group in sorted(met, key=lambda x: -x[0]):
            if start <= group.high and end <= group.high + window:
                group.add(start, end, n, strand)
                break
        else:
            group = ReadGroup(name, float(start), float(end))
            group.add(start, end, n, strand)
            groups.append(group)
    return groups


def homogenised(rows: list[dict], window: int) -> list[dict]:
    """Each row's ends moved to a better supported end within the window; rows that meet add their support."""
    starts, ends = Counter(), Counter()
    for r in rows:
        starts[r["start"]] += r["support"]
        ends[r["end"]] += r["support"]

    def moved(pos: int, support: Counter[int], places: range) -> int:
        best = pos
        for t in places:
            if support.get(t, 0) > support[best]:
                best = t
        return best

    out: dict[tuple[int, int], dict] = {}
    for r in rows:
        s, e = r["start"], r["end"]
        key = moved(s, starts, range(s + window - 1, s - window - 1, -1)), moved(e, ends, range(e - window, e + window))
        if key in out:
            out[key]["support"] += r["support"]
        else:
            out[key] = r | {"start": key[0], "end": key[1]}
    return list(out.values())
