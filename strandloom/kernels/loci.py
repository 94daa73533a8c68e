"""A whole chromosome of few transfrags: loci, strands, units and numbered isoforms, as the operators find them by tables."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from .isoforms import AssemblySettings, assemble
from .splice_graph import Frag

_STRANDS = {"+": 0, "-": 1}


@dataclass
class Transfrag:
    """A sample's exon list; ``order`` are its sample's and its own place."""

    exons: list[tuple[int, int]]
    strand: str
    expr: float
    order: tuple[int, int]
    is_ref: bool = False
    round: int = 0

    @property
    def first(self) -> tuple[int, int, int, int]:
        return self.round, self.exons[0][0], *self.order


def loci(frags: list[Transfrag]) -> list[list[Transfrag]]:
    """Transfrags by locus: a start that reaches no end before it begins one."""
    out: list[list[Transfrag]] = []
    far = None
    for f in sorted(frags, key=lambda f: (f.exons[0][0], f.order)):
        if far is None or f.exons[0][0] >= far:
            out.append([])
            far = f.exons[-1][1]
        out[-1].append(f)
        far = max(far, f.exons[-1][1])
    return out


def _stretches(exons: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what exons cover; those that touch are joined."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(exons):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def take_strands(frags: list[Transfrag]) -> None:
    """Give transfrags of a locus without a strand that of the exons they meet, if it is one, in rounds; each meets only those newly stranded."""
    front = [f for f in frags if f.strand in _STRANDS]
    pending = [f for f in frags if f.strand not in _STRANDS]
    turn = 0
    while front and pending:
        turn += 1
        covered = {s: _stretches([e for f in front if f.strand == s for e in f.exons if e[0] < e[1]]) for s in _STRANDS}
        front, rest = [], []
        for f in pending:
            met = [s for s, (starts, ends) in covered.items() if any((k := bisect_right(ends, a)) < len(ends) and starts[k] < b for a, b in f.exons if a < b)]
            if len(met) == 1:
                f.strand, f.round = met[0], turn
                front.append(f)
            elif not met:
                rest.append(f)
        pending = rest


def units(frags: list[Transfrag]) -> list[list[Transfrag]]:
    """Transfrags of one strand by what is linked by covered stretches."""
    if len(frags) == 1:
        return [frags]
    starts, _ = _stretches([e for f in frags for e in f.exons])
    top = list(range(len(starts)))

    def root(n: int) -> int:
        while top[n] != n:
            top[n] = n = top[top[n]]
        return n

    homes = [[bisect_right(starts, a) - 1 for a, _ in f.exons] for f in frags]
    for own in homes:
        for n in own[1:]:
            top[root(n)] = root(own[0])
    out: dict[int, list[Transfrag]] = {}
    for f, own in zip(frags, homes, strict=True):
        out.setdefault(root(own[0]), []).append(f)
    return list(out.values())


def _lists(frags: list[Transfrag]) -> tuple[tuple, list[Frag]]:
    """The place of a unit's first transfrag, and its distinct exon lists, by the first of each."""
    found: dict[tuple, list[Transfrag]] = {}
    for f in sorted(frags, key=lambda f: f.first):
        found.setdefault((tuple(f.exons), f.is_ref), []).append(f)
    own = list(found.values())
    return own[0][0].first, [Frag(same[0].exons, sum(f.expr for f in same), len(same), same[0].is_ref) for same in own]


def numbered_isoforms(frags: list[Transfrag], settings: AssemblySettings) -> Iterator[tuple[int, int, int, int, str, dict]]:
    """(locus, gene, tss, transcript, strand, isoform), numbered from 1 along the chromosome; a row without an isoform ends it with all numbers."""
    locus = gene = transcript = sites = 0
    whole = settings.guide.ends or settings.guide.assembly
    for locus, own in enumerate(loci(frags), 1):
        take_strands(own)
        for strand in ("+", "-", "."):
            here = [f for f in own if f.strand == strand]
            found = [_lists(unit) for unit in (([here] if whole else units(here)) if here else [])]
            for _, lists in sorted(found, key=lambda x: x[0]):
                before = 0
                for row in assemble(strand, lists, settings, isoforms_only=True)["isoform"]:
                    transcript += 1
                    if not row["rank"]:
                        gene, sites, before = gene + 1, sites + 1, sites
                    sites = max(sites, before + row["site"] + 1)
                    yield locus, gene, before + row["site"] + 1, transcript, strand, row
    yield locus, gene, sites, transcript, "", {}
