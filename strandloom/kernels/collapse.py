"""Reads of one gene to transcript models: grouping, votes on every edge, and order."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

from .models import Model, Tolerance, same_capped, same_uncapped


@dataclass(frozen=True)
class Read:
    """An accepted read: its exons and, for each junction in genome order, the error tokens before and after it."""

    name: str
    model: Model
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class CollapseSettings:
    """``capped``: 5' ends are real. ``longest``: outer ends are the longest, else the commonest. ``by_errors``: clean junctions vote first."""

    capped: bool = True
    longest: bool = False
    by_errors: bool = False
    tolerance: Tolerance = Tolerance()


@dataclass
class Collapsed:
    """A model with its reads; per exon in genome order the wobble of either edge and the vote's error rank."""

    exons: list[tuple[int, int]]
    reads: list[str]
    start_wobble: list[int]
    end_wobble: list[int]
    start_rank: list[int]
    end_rank: list[int]
    start_tokens: list[str]
    end_tokens: list[str]


def genes_of(models: list[Model]) -> list[list[int]]:
    """Indexes of models that share or touch exons, directly or through others, in order of place."""
    exons = sorted((s, e, k) for k, m in enumerate(models) for s, e in m.exons)
    parent = list(range(len(models)))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    reach, owner = None, -1
    for s, e, k in exons:
        if reach is not None and s <= reach:
            parent[find(k)] = find(owner)
            reach = max(reach, e)
        else:
            reach = e
        owner = k
    groups = defaultdict(list)
    for k in range(len(models)):
        groups[find(k)].append(k)
    return sorted(groups.values(), key=lambda g: min(models[k].exons[0][0] for k in g))


def capped_groups(reads: list[Read], tolerance: Tolerance) -> list[list[Read]]:
    """Reads that are the same model, directly or through others."""
    left = sorted(reads, key=lambda r: r.name)
    groups = []
    while left:
        group, at = [left.pop(0)], 0
        while at < len(group):
            same = [r for r in left if same_capped(group[at].model, r.model, tolerance)]
            left = [r for r in left if r not in same]
            group += same
            at += 1
        groups.append(group)
    return groups


def uncapped_groups(reads: list[Read], tolerance: Tolerance) -> list[list[Read]]:
    """Groups from the most exons and the most 5' read down; a shorter read joins every group of the longer reads it fits.

    Ties of place go by name. A read that was taken for a shorter form no longer gathers its equals.
    """
    five = lambda r: (r.model.exons[0][0] if r.model.strand == "+" else -r.model.exons[-1][1], r.name)
    levels = defaultdict(list)
    for r in sorted(reads, key=five):
        levels[len(r.model.exons)].append(r)
    groups: dict[int, list[Read]] = {}
    of: dict[Read, set[int]] = {}
    shortened: set[Read] = set()
    number = 0

    def own(r: Read) -> set[int]:
        nonlocal number
        if r not in of:
            number += 1
            of[r], groups[number] = {number}, [r]
        return of[r]

    def join(short: Read, long: Read) -> None:
        mine = own(short)
        if len(mine) == 1 and len(groups[next(iter(mine))]) == 1:
            del groups[mine.pop()]
        for g in own(long) - mine:
            mine.add(g)
            groups[g].append(short)

    for level in sorted(levels, reverse=True):
        waiting = list(levels[level])
        while waiting:
            hunters = [waiting.pop(0)]
            while hunters:
                hunter = hunters.pop(0)
                own(hunter)
                found = []
                if hunter not in shortened:
                    for prey in waiting:
                        if not own(prey) & own(hunter) and same_uncapped(hunter.model, prey.model, tolerance):
                            join(prey, hunter)
                            found.append(prey)
                for lower in sorted((x for x in levels if x < level), reverse=True):
                    for prey in levels[lower]:
                        if not own(prey) & own(hunter) and same_uncapped(hunter.model, prey.model, tolerance):
                            join(prey, hunter)
                            shortened.add(prey)
                hunters = sorted({*hunters, *found}, key=lambda r: r.name)
    return list(groups.values())


def error_rank(near: str, far: str) -> int:
    """0 both sides of a junction clean, 1 only the edge's own side, 2 only the other, 3 neither."""
    return (near != "0") * 2 + (far != "0")


def _ballots(read: Read, k: int, by_errors: bool) -> tuple[int, str, int, str]:
    """(rank, tokens) of the start and of the end of exon k in genome order."""
    start = end = (0, "na")
    if k > 0:
        a, b = read.before[k - 1], read.after[k - 1]
        start = error_rank(b, a), f"{a}>{b}"
    if k < len(read.model.exons) - 1:
        a, b = read.before[k], read.after[k]
        end = error_rank(a, b), f"{a}>{b}"
    return (start[0] if by_errors else 0), start[1], (end[0] if by_errors else 0), end[1]


def _winner(votes: list[tuple[int, int, str]], *, largest: bool) -> tuple[int, int, int]:
    """(commonest, outermost, rank) among the best-ranked coordinates; ties go outwards."""
    rank = min(v[0] for v in votes)
    counts = Counter(c for r, c, _ in votes if r == rank)
    outer = max if largest else min
    most = max(counts.values())
    return outer(c for c, n in counts.items() if n == most), outer(counts), rank


def vote(reads: list[Read], settings: CollapseSettings) -> Collapsed:
    """Every edge by the votes of the reads that have its exon, counted from the 3' end.

    Without caps a shorter read says nothing about the 5' edge of its first exon, and the model's
    own 5' end is the outermost. Edges that cross fall back to the outermost ones.
    """
    strand = reads[0].model.strand
    n = max(len(r.model.exons) for r in reads)
    rows = []
    for i in range(n):
        starts, ends = [], []
        for r in reads:
            size = len(r.model.exons)
            if i < size:
                k = size - 1 - i if strand == "+" else i
                s_rank, s_text, e_rank, e_text = _ballots(r, k, settings.by_errors)
                cut = not settings.capped and i == size - 1 and i < n - 1
                if not (cut and strand == "+"):
                    starts.append((s_rank, r.model.exons[k][0], s_text))
                if not (cut and strand == "-"):
                    ends.append((e_rank, r.model.exons[k][1], e_text))
        (start, far_start, s_rank), (end, far_end, e_rank) = _winner(starts, largest=False), _winner(ends, largest=True)
        wide_five = i == n - 1 and (settings.longest or not settings.capped)
        wide_three = i == 0 and settings.longest
        if wide_five if strand == "+" else wide_three:
            start = far_start
        if wide_three if strand == "+" else wide_five:
            end = far_end
        if start > end:
            if far_start >= far_end:
                raise ValueError(f"a model's start {start} lies past its end {end}")
            start, end = far_start, far_end
        tokens = lambda votes, rank, at: "-".join(sorted({t for r, c, t in votes if r == rank and c == at}))
        spread = lambda votes: max(v[1] for v in votes) - min(v[1] for v in votes)
        rows.append((start, end, spread(starts), spread(ends), s_rank, e_rank, tokens(starts, s_rank, start), tokens(ends, e_rank, end)))
    rows.sort(key=lambda r: r[0])
    if any(a[1] > b[0] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("a model's exons overlap")
    columns = [list(c) for c in zip(*rows, strict=True)]
    return Collapsed([(r[0], r[1]) for r in rows], [r.name for r in reads], *columns[2:])


def collapse_gene(reads: list[Read], settings: CollapseSettings, *, merge_equal: bool = True) -> list[Collapsed]:
    """A gene's models in order of their exon lists; groups that vote for the same exons are one model (or an error)."""
    groups = capped_groups(reads, settings.tolerance) if settings.capped else uncapped_groups(reads, settings.tolerance)
    found: dict[tuple, list[Read]] = {}
    for group in groups:
        key = tuple(vote(group, settings).exons)
        if key in found and not merge_equal:
            raise ValueError("two groups of a gene give the same model")
        found[key] = list(dict.fromkeys([*found.get(key, []), *group]))
    models = [vote(sorted(group, key=lambda r: r.name), settings) for group in found.values()]
    return sorted(models, key=lambda m: (m.exons[0][0], m.exons[-1][1], [s for s, _ in m.exons], [e for _, e in m.exons]))
