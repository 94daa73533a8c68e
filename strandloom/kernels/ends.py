"""End groups of one intron chain, their representatives and names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class Isoform:
    """One sample's isoform on a chain; ordered as chains are walked."""

    start: int
    end: int
    sample: str
    name: str
    usage: float
    counts: int

    @property
    def length(self) -> int:
        return self.end - self.start

    @property
    def gene(self) -> str:
        return self.name.rsplit("_", 1)[-1]


@dataclass(frozen=True)
class CombineSettings:
    """``window``: how far ends may advance within a group; ``percent``: usage to exceed;
    ``rule``: none, usageandlongest, usage, or a number that counts must exceed; ``prefix``: of unannotated names."""

    window: int = 200
    percent: float = 10.0
    rule: str = "usageandlongest"
    prefix: str = "isoform"

    @property
    def least_counts(self) -> float:
        return int(self.rule) if re.fullmatch(r"-?\d+", self.rule) else float("inf")


def representative(members: Sequence[Isoform]) -> Isoform:
    """The member with the largest usage, the longest of these, the first of those; usage must be positive."""
    if members[0].usage == 0:
        raise ValueError("an isoform's usage is 0")
    positive = [m for m in members if m.usage > 0]
    if not positive:
        raise ValueError("no isoform with positive usage")
    return max(positive, key=lambda m: (m.usage, m.length))


def end_groups(isoforms: Sequence[Isoform], window: int) -> list[tuple[Isoform, list[Isoform]]]:
    """(representative, members): a new group where start or end lies more than ``window`` beyond the row before.

    The walk starts at 0; a later group with an equal representative replaces the earlier one's members.
    """
    groups: dict[Isoform, list[Isoform]] = {}
    run: list[Isoform] = []
    start = end = 0
    for isoform in sorted(isoforms):
        if run and (isoform.start - start > window or isoform.end - end > window):
            groups[representative(run)] = run
            run = []
        run.append(isoform)
        start, end = isoform.start, isoform.end
    if run:
        groups[representative(run)] = run
    return list(groups.items())


def most_common(values: Sequence[str]) -> str:
    """The commonest value, the first seen of equally common ones."""
    return max(dict.fromkeys(values), key=list(values).count)


def gene_name(members: Sequence[Isoform]) -> str:
    """The last gene accession in the members' names, else the last chromosome name, else the commonest last token."""
    accession = chromosome = None
    for m in members:
        if (at := m.name.rfind("ENSG")) >= 0:
            accession = m.name[at:]
        if (at := m.name.rfind("chr")) >= 0:
            chromosome = m.name[at:]
    return accession or chromosome or most_common([m.gene for m in members])


def set_aside_name(members: Sequence[Isoform]) -> str:
    """The name under which isoforms too weak to keep are gathered."""
    accession = [m.gene for m in members if m.gene.startswith("ENSG")]
    return f"lowexpiso_{accession[-1] if accession else most_common([m.gene for m in members])}"


def annotated(name: str) -> bool:
    """A transcript accession joined to exactly one gene accession."""
    prefix, *rest = name.split("ENSG")
    return name.startswith("ENST") and len(prefix) < 25 and len(rest) == 1


@dataclass
class ChainResult:
    """What a chain gives: (end number, name tail, kept, representative, members) rows; the name for a weak chain that follows."""

    kept: bool
    rows: list[tuple[int, str, bool, Isoform, list[Isoform]]]
    tail_name: str


def combine_chain(isoforms: Sequence[Isoform], settings: CombineSettings, *, fusion: bool, single: bool) -> ChainResult:
    """Groups, filters and names one chain. A name tail ``-k_gene`` or ``-k_accession`` gets the chain's number in front."""
    groups = end_groups(isoforms, settings.window)
    least = settings.percent / 100
    members = [m for _, own in groups for m in own]
    strong = settings.rule == "none" or max(m.usage for m in members) > least or sum(m.counts for m in members) > settings.least_counts
    if not strong:
        return ChainResult(False, [(k, "", False, rep, own) for k, (rep, own) in enumerate(groups, 1)], set_aside_name(groups[-1][1]))
    spans = [(rep.start, rep.end) for rep, _ in groups if rep.length]
    longest = spans[-1] if spans else None
    rows = []
    for k, (rep, own) in enumerate(groups, 1):
        own = sorted(own, key=lambda m: -m.length)
        keep = settings.rule == "none" or max(m.usage for m in own) > least or sum(m.counts for m in own) > settings.least_counts or settings.rule == "usageandlongest" and not single and longest == (rep.start, rep.end)
        if not keep:
            tail = set_aside_name(own)
        elif fusion:
            tail = f"-{k}_{most_common([m.gene for m in own])}"
        else:
            known = next((m.name for m in own if annotated(m.name)), None)
            tail = f"-{k}_{known or gene_name(own)}"
            tail = tail if known is None else "=" + tail
        rows.append((k, tail, keep, rep, own))
    return ChainResult(True, rows, set_aside_name(rows[-1][4]))
