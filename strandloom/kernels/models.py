"""When two transcript models are one: exon by exon from the 3' end, with a tolerance for each kind of end."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Model:
    """Exons as (start, end) in order, and the strand."""

    strand: str
    exons: tuple[tuple[int, int], ...]

    def from_three_prime(self) -> list[tuple[int, int]]:
        """Exons from the 3' end as (3' edge, 5' edge), mirrored on the minus strand so that 5' lies at smaller numbers."""
        if self.strand == "+":
            return [(e, s) for s, e in reversed(self.exons)]
        if self.strand == "-":
            return [(-s, -e) for s, e in self.exons]
        raise ValueError(f"bad strand {self.strand}")


@dataclass(frozen=True)
class Tolerance:
    five_prime: int = 10
    splice: int = 10
    three_prime: int = 10


def _apart(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """No shared base (touching is apart)."""
    return a[1] >= b[0] or b[1] >= a[0]


def same_capped(a: Model, b: Model, t: Tolerance) -> bool:
    """Equal numbers of exons, all overlapping, all edges within their tolerance."""
    x, y = a.from_three_prime(), b.from_three_prime()
    if len(x) != len(y):
        return False
    last = len(x) - 1
    for k, (p, q) in enumerate(zip(x, y, strict=True)):
        if _apart(p, q) or abs(p[0] - q[0]) > (t.three_prime if k == 0 else t.splice) or abs(p[1] - q[1]) > (t.five_prime if k == last else t.splice):
            return False
    return True


def same_uncapped(a: Model, b: Model, t: Tolerance) -> bool:
    """The shorter model is the longer one's 3' part; it may begin anywhere inside the exon in which it begins.

    With equal numbers of exons the 5' edge is free altogether.
    """
    x, y = a.from_three_prime(), b.from_three_prime()
    last = min(len(x), len(y)) - 1
    for k, (p, q) in enumerate(zip(x, y, strict=False)):
        if _apart(p, q) or abs(p[0] - q[0]) > (t.three_prime if k == 0 else t.splice):
            return False
        if abs(p[1] - q[1]) > t.splice:
            if k < last:
                return False
            if len(x) != len(y) and not (p[1] > q[1] if len(x) < len(y) else q[1] > p[1]):
                return False
    return True
