"""Placing a read among a metagene's genes and isoforms by its cover of disjoint sub-exons."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KNOWN, NOVEL, NONE = "known", "novel", "uncategorized"


@dataclass(frozen=True)
class MatchSettings:
    """A sub-exon counts as skipped up to ``low`` and as matched from ``high`` on; see the functions for the rest."""

    low: float = 0.1
    high: float = 0.6
    small_exon: int = 0
    small_exon_high: int = 80
    truncation: float = 0.4


@dataclass(frozen=True)
class GeneModel:
    """A gene over its disjoint half-open sub-exons; isoforms are 0/1 rows over them."""

    gene_id: str
    start: int
    end: int
    strand: str
    bounds: np.ndarray  # n x 2
    isoforms: np.ndarray  # m x n, bool

    @property
    def lengths(self) -> np.ndarray:
        return self.bounds[:, 1] - self.bounds[:, 0]


def covered(blocks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bases of the aligned blocks (k x 2) on each sub-exon."""
    if not len(blocks):
        return np.zeros(len(bounds), dtype=np.int64)
    shared = np.minimum(blocks[:, None, 1], bounds[None, :, 1]) - np.maximum(blocks[:, None, 0], bounds[None, :, 0])
    return np.maximum(shared, 0).sum(axis=0)


def half_even(x: np.ndarray) -> np.ndarray:
    """Two decimals; a fraction within 1e-8 of a half goes to the even neighbour."""
    scaled = x * 100
    whole = np.floor(scaled)
    part = scaled - whole
    up = np.where(np.abs(part - 0.5) < 1e-8, whole % 2 == 1, part > 0.5)
    return (whole + up) / 100


def mend_truncation(share: np.ndarray, lengths: np.ndarray, strand: str, tailed: bool, least: float) -> np.ndarray:
    """The outermost touched sub-exon counts as whole where enough of it is covered.

    With a poly tail only the 5' end can be cut short (100 bases suffice); without one, the end
    with more covered bases is mended (more than 100 bases), the left one on ties.
    """
    touched = np.flatnonzero(share > 0)
    if not len(touched):
        return share
    bases = share * lengths

    def mended(at: int, enough: bool) -> np.ndarray:
        out = share.copy()
        if enough:
            out[at] = 1.0
        return out

    if tailed:
        at = touched[-1] if strand == "-" else touched[0]
        return mended(at, share[at] >= least or bases[at] >= 100)
    ends = [(at, bool(share[at] >= least or bases[at] > 100)) for at in (touched[0], touched[-1])]
    left, right = (bases[at] if enough else 0.0 for at, enough in ends)
    return mended(*ends[0]) if left >= right else mended(*ends[1])


def read_vector(share: np.ndarray, settings: MatchSettings, tailed: bool, strand: str) -> np.ndarray:
    """1 matched, -1 skipped, 0 unknown; beyond the outer matches nothing is known (with a tail, only on the 5' side)."""
    raw = (share >= settings.high).astype(np.int8) - (share <= settings.low).astype(np.int8)
    hit = np.flatnonzero(raw == 1)
    if not len(hit):
        return np.zeros_like(raw)
    known = np.ones(len(raw), dtype=bool)
    if not tailed or strand != "-":
        known[: hit[0]] = False
    if not tailed or strand == "-":
        known[hit[-1] + 1 :] = False
    return np.where(known, raw, 0).astype(np.int8)


def compatible(isoforms: np.ndarray, vector: np.ndarray, lengths: np.ndarray, small: int) -> np.ndarray:
    """Isoforms that neither skip a matched sub-exon nor hold a skipped one; sub-exons shorter than ``small`` do not count."""
    seen = np.where(lengths >= small, vector, 0)
    return ~((isoforms & (seen == -1)) | (~isoforms & (seen == 1))).any(axis=1)


def assign(gene: GeneModel, counts: np.ndarray, settings: MatchSettings, tailed: bool) -> tuple[str, int, np.ndarray | None, float]:
    """(kind, isoform, vector, score) of a read on one gene."""
    bases = int(counts.sum())
    if not bases:
        return NONE, -1, None, -1.0
    lengths = gene.lengths
    share = half_even(np.divide(counts, lengths, out=np.zeros(len(counts)), where=lengths > 0))
    share = mend_truncation(share, lengths, gene.strand, tailed, settings.truncation)
    vector = read_vector(share, settings, tailed, gene.strand)
    if not vector.any():
        share[int(np.argmax(share))] = 1.0
        vector = read_vector(share, settings, tailed, gene.strand)
    small, cap = settings.small_exon, max(settings.small_exon, min(settings.small_exon_high, int(np.floor(lengths.mean()))))
    fits = compatible(gene.isoforms, vector, lengths, small)
    while not fits.any() and small + 10 <= cap:
        small += 10
        fits = compatible(gene.isoforms, vector, lengths, small)
    if not fits.any():
        return NOVEL, -1, vector, -1.0
    hits = np.flatnonzero(fits)
    if len(hits) > 1:
        low, high = settings.low, settings.high
        level = np.where(share > high, 1.0, np.where(share < low, 0.0, (share - low) / (high - low) if high > low else 0.0))
        hits = hits[[int(np.argmin(np.abs(gene.isoforms[hits] - level).sum(axis=1)))]]
    length = int(lengths[gene.isoforms[hits[0]]].sum())
    return KNOWN, int(hits[0]), vector, bases / length if length > 0 else -1.0


def place(genes: list[GeneModel], tailed: list[bool], blocks: np.ndarray, start: int, end: int, settings: MatchSettings) -> tuple[int, str, int, np.ndarray | None, float] | None:
    """(gene, kind, isoform, vector, score): the metagene's best gene for a read.

    Known before novel before uncategorised, then covered bases, joint span, gene length, order;
    where no gene is covered the one with the largest joint span.
    """
    rows = []
    for k, gene in enumerate(genes):
        if len(gene.bounds):
            counts = covered(blocks, gene.bounds)
            rows.append((k, counts, int(counts.sum()), max(end, gene.end) - min(start, gene.start), gene.end - gene.start))
    if not rows:
        return None
    hit = [r for r in rows if r[2] > 0]
    if not hit:
        k, counts, *_ = min(rows, key=lambda r: (-r[3], r[0]))
        return k, *assign(genes[k], counts, settings, tailed[k])
    hit.sort(key=lambda r: (-r[2], -r[3], -r[4], r[0]))
    if len(hit) == 1 or sum(r[2] for r in hit) < 2:
        k, counts, *_ = hit[0]
        return k, *assign(genes[k], counts, settings, tailed[k])
    rank = {KNOWN: 0, NOVEL: 1, NONE: 2}
    found = [(r, assign(genes[r[0]], r[1], settings, tailed[r[0]])) for r in hit]
    r, outcome = min(found, key=lambda x: (rank[x[1][0]], -x[0][2], -x[0][3], -x[0][4], x[0][0]))
    return r[0], *outcome


def _rich_window(seq: str, start: int, end: int, base: str) -> bool:
    """A window of 15 with 10 or more of the base, inside seq[start, end)."""
    part = np.frombuffer(seq[max(0, start) : max(0, end)].upper().encode(), dtype=np.uint8) == ord(base)
    if len(part) < 15:
        return False
    running = np.concatenate(([0], np.cumsum(part)))
    return bool((running[15:] - running[:-15] >= 10).any())


def edge_tail(seq: str, query_start: int, query_end: int) -> bool:
    """A T-rich head or an A-rich tail around the aligned part's ends."""
    n = len(seq)
    head = max(0, query_start - 30), min(query_start + 15, query_end, n - 1) + 1
    tail = max(query_start, query_end - 15), min(query_end + 30, n - 1) + 1
    return _rich_window(seq, *head, "T") or _rich_window(seq, *tail, "A")


def molecule_tail(seq: str, query_start: int, query_end: int, umi: str | None) -> bool:
    """A poly tail next to the molecule's barcode; by the edges where the barcode is unknown or not in the read."""
    if not seq:
        return False
    if not umi or umi == "NA":
        return edge_tail(seq, query_start, query_end)
    back = umi[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca", "")) if set(umi) <= set("ACGTacgt") else "".join({"A": "T", "C": "G", "G": "C", "T": "A", "a": "t", "c": "g", "g": "c", "t": "a"}.get(c, "N") for c in reversed(umi))
    at, at_back = seq.find(umi), seq.find(back)
    if at >= 0 and seq[at + len(umi) : at + len(umi) + 15].upper().count("T") >= 10:
        return True
    if at_back >= 0:
        return seq[max(0, at_back - 15) : at_back].upper().count("A") >= 10
    return at < 0 and edge_tail(seq, query_start, query_end)


def genomic_run(genome: str, start: int, end: int, base: str) -> int:
    """The longest run of the base in genome[start, end), clamped."""
    best = run = 0
    for c in genome[max(0, start) : max(0, end)].upper():
        run = run + 1 if c == base else 0
        best = max(best, run)
    return best
