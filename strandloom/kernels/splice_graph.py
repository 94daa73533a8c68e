"""Splice graphs: exon lists cut at their common boundaries into nodes, and walked from start to stop.

A node is the place of an interval between two neighbouring boundaries. Coverage is kept by segment,
not by base; it adds up in single precision, in the order of the exon lists.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from .changepoints import ChangePoint, change_points

#: The smallest node that is searched for change points, by the width of the smoothing there.
CHANGE_WINDOW = 11


@dataclass
class Frag:
    """A distinct exon list (half-open, ascending) with the summed expression of its ``n`` transfrags."""

    exons: list[tuple[int, int]]
    expr: float
    n: int = 1
    known: bool = False

    @property
    def introns(self) -> list[tuple[int, int]]:
        return [(a[1], b[0]) for a, b in zip(self.exons, self.exons[1:], strict=False)]


@dataclass
class Guide:
    """What the reference's models are used for: their ends as boundaries, or their exons as paths."""

    ends: bool = False
    assembly: bool = False


class Coverage:
    """Expression by segment between all exon edges."""

    def __init__(self, low: int, high: int, frags: Iterable[Frag]):
        frags = list(frags)
        self.edges = np.unique(np.array([low, high, *(p for f in frags for e in f.exons for p in e)], dtype=np.int64))
        self.values = np.zeros(len(self.edges) - 1, dtype=np.float32)
        for f in frags:
            at = np.searchsorted(self.edges, np.array(f.exons, dtype=np.int64))
            for a, b in at.tolist():
                self.values[a:b] += np.float32(f.expr)

    def crossings(self) -> list[int]:
        """Where coverage begins or ends inside the covered range."""
        on = self.values > 0
        return self.edges[1:-1][on[1:] != on[:-1]].tolist()

    def steps(self, bounds: np.ndarray) -> np.ndarray:
        """How often the value changes inside each stretch between two neighbouring bounds."""
        at = self.edges[1:-1][self.values[1:] != self.values[:-1]]
        return np.searchsorted(at, bounds[1:], "left") - np.searchsorted(at, bounds[:-1], "right")

    def bases(self, start: int, end: int) -> np.ndarray:
        """The value of every base."""
        a, b = np.searchsorted(self.edges, start, "right") - 1, np.searchsorted(self.edges, end)
        cuts = np.clip(self.edges[a : b + 1], start, end)
        return np.repeat(self.values[a:b], np.diff(cuts))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and values of the runs of equal value above zero."""
        new = np.r_[True, self.values[1:] != self.values[:-1]]
        starts, values = self.edges[:-1][new], self.values[new]
        ends = np.r_[starts[1:], self.edges[-1]]
        return starts[values != 0], ends[values != 0], values[values != 0]


@dataclass
class Walk:
    """A frag as nodes in the direction of its strand."""

    nodes: list[int]
    frag: Frag
    from_source: bool = False
    to_sink: bool = False


@dataclass
class SpliceGraph:
    """The graph of one strand's frags. ``start_sites`` and ``stop_sites`` are boundaries found by change points."""

    strand: str
    frags: list[Frag]
    guide: Guide = field(default_factory=Guide)
    start_sites: frozenset[int] = frozenset()
    stop_sites: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        if not self.frags or not all(f.exons for f in self.frags):
            raise ValueError("a splice graph needs frags, and each of them exons")
        self.low, self.high = min(f.exons[0][0] for f in self.frags), max(f.exons[-1][1] for f in self.frags)
        self.own, self.known = ([f for f in self.frags if f.known is k] for k in (False, True))
        self.coverage = Coverage(self.low, self.high, self.own)
        first, last = (sorted({f.exons[k][k] for f in self.known}) for k in (0, -1))
        self.known_starts, self.known_stops = (last, first) if self.minus else (first, last)
        self.bounds = self._bounds()
        self.walks = [Walk(self._nodes(f), f) for f in self.own + (self.known if self.guide.assembly else [])]
        self._mark_ends()

    @property
    def minus(self) -> bool:
        return self.strand == "-"

    def _bounds(self) -> np.ndarray:
        spliced = self.own + (self.known if self.guide.assembly else [])
        found = {self.low, self.high, *self.start_sites, *self.stop_sites, *self.coverage.crossings()}
        found.update(p for f in spliced for gap in f.introns for p in gap)
        if self.guide.ends:
            found.update(p for f in self.known for p in (f.exons[0][0], f.exons[-1][1]))
        return np.array(sorted(found), dtype=np.int64)

    def _nodes(self, frag: Frag) -> list[int]:
        """The nodes an exon list touches: both edges of all exons are looked up at once."""
        edges = np.array(frag.exons, dtype=np.int64)
        first = np.searchsorted(self.bounds, edges[:, 0], "right") - 1
        after = np.maximum(np.searchsorted(self.bounds, edges[:, 1]), first + 1)
        if first.min() < 0 or after.max() >= len(self.bounds):
            raise ValueError(f"an exon of {frag.exons} lies outside the graph's boundaries")
        nodes = [n for a, b in zip(first.tolist(), after.tolist(), strict=True) for n in range(a, b)]
        return nodes[::-1] if self.minus else nodes

    def _mark_ends(self) -> None:
        """A node starts if nothing leads to it, or at a start site; it stops likewise."""
        used = {n for w in self.walks for n in w.nodes}
        steps = [step for w in self.walks for step in zip(w.nodes, w.nodes[1:], strict=False)]
        self.starts, self.stops = used - {b for _, b in steps}, used - {a for a, _ in steps}
        begin, end = set(self.start_sites), set(self.stop_sites)
        if self.guide.ends:
            begin.update(self.known_starts)
            end.update(self.known_stops)
        for marks, sites, upstream in ((self.starts, begin, not self.minus), (self.stops, end, self.minus)):
            # the node that opens at the site, or the one that closes there
            at = np.searchsorted(self.bounds, sorted(sites), "right" if upstream else "left")
            marks.update(i - 1 for i in at.tolist() if 0 < i < len(self.bounds) and i - 1 in used)
        for w in self.walks:
            w.from_source, w.to_sink = w.nodes[0] in self.starts, w.nodes[-1] in self.stops

    def span(self, node: int) -> tuple[int, int]:
        return int(self.bounds[node]), int(self.bounds[node + 1])

    def nodes(self) -> list[int]:
        """All nodes that a walk uses, as they are first met."""
        return list(dict.fromkeys(n for w in self.walks for n in w.nodes))

    def parts(self) -> list[SpliceGraph]:
        """A graph for each component, by its first walk; one component keeps the whole graph."""
        top: dict[int, int] = {}

        def root(n: int) -> int:
            while top.setdefault(n, n) != n:
                top[n] = n = top[top[n]]
            return n

        for w in self.walks:
            for n in w.nodes:
                top[root(n)] = root(w.nodes[0])
        groups: dict[int, list[Frag]] = {}
        for w in self.walks:
            groups.setdefault(root(w.nodes[0]), []).append(w.frag)
        return [self] if len(groups) < 2 else [SpliceGraph(self.strand, g, self.guide) for g in groups.values()]

    def changes(self, p: float, fold: float) -> list[ChangePoint]:
        """Change points of the coverage of every node; one that changes less than twice has none."""
        found = []
        steps = self.coverage.steps(self.bounds).tolist()
        for n in self.nodes():
            start, end = self.span(n)
            if steps[n] > 1 and end - start >= CHANGE_WINDOW:
                found += [ChangePoint(c.pos + start, c.start + start, c.end + start, c.p, c.ratio, c.sign) for c in change_points(self.coverage.bases(start, end), p=p, fold=fold, window=CHANGE_WINDOW)]
        return found

    def changed(self, changes: list[ChangePoint], *, trim: bool) -> SpliceGraph:
        """The graph anew, with the change points as start or stop sites; ``trim`` moves frags' ends on their slopes there.

        Whether an end lies on a slope is asked of the frags as they were, whatever an earlier change moved.
        """
        falls = [c for c in changes if c.sign < 0]
        rises = [c for c in changes if c.sign >= 0]
        starts, stops = (falls, rises) if self.minus else (rises, falls)
        own = self.own
        if trim:
            own = [Frag(list(f.exons), f.expr, f.n) for f in self.own]
            for c in changes:
                for old, new in zip(self.own, own, strict=True):
                    _trim(old, new, c)
        return SpliceGraph(self.strand, own + self.known, self.guide, self.start_sites | {c.pos for c in starts}, self.stop_sites | {c.pos for c in stops})

    def node_rows(self) -> list[dict]:
        """Span and coverage of every node, and the known ends in it (those at its own start left out)."""
        rows = []
        for n in self.nodes():
            start, end = self.span(n)
            values = self.coverage.bases(start, end)
            inside = lambda ends: [p for p in ends if start < p <= end]  # noqa: B023, E731
            rows.append({"start": start, "end": end, "least": float(values.min()), "most": float(values.max()), "mean": float(np.cumsum(values, dtype=np.float32)[-1] / np.float32(len(values))), "known_starts": inside(self.known_starts), "known_stops": inside(self.known_stops)})
        return rows

    def exons(self, nodes: list[int]) -> list[tuple[int, int]]:
        """A path's nodes as exons: nodes that touch are joined."""
        out: list[list[int]] = []
        for n in reversed(nodes) if self.minus else nodes:
            start, end = self.span(n)
            if out and out[-1][1] == start:
                out[-1][1] = end
            else:
                out.append([start, end])
        return [(a, b) for a, b in out]


def _trim(old: Frag, new: Frag, c: ChangePoint) -> None:
    """Move the end that lies on the slope of a change to its point, unless the outer exon begins on that slope."""
    if c.sign < 0:
        inner = new.exons[-1][0]
        if c.pos < old.exons[-1][1] <= c.end and not c.pos <= inner <= c.end:
            new.exons[-1] = (inner, c.pos)
    else:
        inner = new.exons[0][1]
        if c.start <= old.exons[0][0] < c.pos and not c.start <= inner <= c.pos:
            new.exons[0] = (c.pos, inner)
