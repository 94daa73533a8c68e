"""Errors of an aligned read against the genome: counts, variant events, and tokens around each junction."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Which bases a code may stand for. The ambiguity codes K, M, Y and R differ from the usual ones on purpose.
BASE_CODES = {"A": "A", "T": "T", "C": "C", "G": "G", "S": "CG", "W": "AT", "K": "AC", "M": "GT", "Y": "AG", "R": "CT", "V": "CGT", "H": "AGT", "D": "ACT", "B": "ACG", "N": "ATCG"}
_BITS = np.zeros(256, dtype=np.uint8)
for _code, _set in BASE_CODES.items():
    _BITS[ord(_code)] = sum(1 << "ACGT".index(b) for b in _set)
NOTHING = "0"
POLYA_WINDOW = 20


def mismatches(genome: str, read: str) -> np.ndarray:
    """Offsets at which no base fits both codes; the read's case does not count, unknown codes are errors."""
    if len(genome) != len(read):
        raise ValueError("genome and read stretch differ in length")
    g, r = (_BITS[np.frombuffer(x.encode("latin-1"), dtype=np.uint8)] for x in (genome, read.upper()))
    for bits, text in ((g, genome), (r, read)):
        if not bits.all():
            raise ValueError(f"unknown base {text[int(np.argmin(bits))]}")
    return np.flatnonzero((g & r) == 0)


def _cut(text: str, start: int, end: int) -> str:
    if start < 0 or end > len(text):
        raise ValueError(f"stretch {start}:{end} lies outside a sequence of {len(text)}")
    return text[start:end]


@dataclass
class ReadErrors:
    """Counts by kind, (position, kind, sequence) events, and the token strings before and after each junction."""

    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys("HSIDX", 0))
    events: list[tuple[int, str, str]] = field(default_factory=list)
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)


def walk(start: int, ops: list[tuple[int, str]], seq: str, genome: str, threshold: int) -> ReadErrors:
    """Walk an alignment from ``start`` (1-based).

    Clips are placed by the running total of their kind, a closing soft clip one further. Junctions
    at an edge and other operations are errors.
    """
    out = ReadErrors()
    at, read_at = start - 1, 0
    seen: list[tuple[int, str]] = []  # mismatch positions so far, with their read.genome bases
    for i, (n, op) in enumerate(ops):
        if op == "H":
            out.counts["H"] += n
            out.events.append((at - out.counts["H"], "H", "N" * out.counts["H"]))
        elif op == "S":
            out.counts["S"] += n
            out.events.append((at - out.counts["S"] + (i == len(ops) - 1), "S", _cut(seq, read_at, read_at + n)))
            read_at += n
        elif op == "M":
            read, ref = _cut(seq, read_at, read_at + n), _cut(genome, at, at + n)
            for k in mismatches(ref, read).tolist():
                out.counts["X"] += 1
                out.events.append((at + k, "M", read[k]))
                seen.append((at + k, f"{read[k]}.{ref[k]}"))
            read_at += n
            at += n
        elif op == "I":
            out.counts["I"] += n
            out.events.append((at, "I", _cut(seq, read_at, read_at + n)))
            read_at += n
        elif op == "D":
            out.counts["D"] += n
            out.events.append((at, "D", str(n)))
            at += n
        elif op == "N":
            if i in (0, len(ops) - 1):
                raise ValueError("junction at the edge of an alignment")
            out.before.append("_".join(reversed(_tokens_before(ops[:i], at, seen, threshold) or [NOTHING])))
            at += n
            out.after.append("_".join(_tokens_after(ops[i + 1 :], at, read_at, seq, genome, threshold) or [NOTHING]))
        else:
            raise ValueError(f"operation {n}{op} is unknown here")
    return out


def _tokens_before(ops: list[tuple[int, str]], junction: int, seen: list[tuple[int, str]], threshold: int) -> list[str]:
    """Tokens from the junction backwards. The operation that passes the threshold is still looked at; a junction ends it."""
    tokens: list[str] = []
    reach, at, rest = 0, junction, len(seen)
    for n, op in reversed(ops):
        if reach > threshold or op == "N":
            break
        reach += n
        if op != "M":
            tokens.append(f"{n}{op}")
        else:
            found = rest
            while found and at - n <= seen[found - 1][0] <= at and junction - seen[found - 1][0] <= threshold:
                found -= 1
                tokens.append(f"{junction - seen[found][0]}.{seen[found][1]}")
            if found == rest and reach <= threshold:
                tokens.append(f"{n}M")
            rest = found
        at -= n
    return tokens


def _tokens_after(ops: list[tuple[int, str]], junction: int, read_at: int, seq: str, genome: str, threshold: int) -> list[str]:
    """Tokens from the junction onwards; mismatches are listed while the one before lies below the threshold."""
    tokens: list[str] = []
    reach, at = 0, junction
    for n, op in ops:
        if reach > threshold or op == "N":
            break
        reach += n
        if op != "M":
            tokens.append(f"{n}{op}")
        else:
            read, ref = _cut(seq, read_at, read_at + n), _cut(genome, at, at + n)
            offsets = [at - junction + k for k in mismatches(ref, read).tolist()]
            listed, last = 0, offsets[0] if offsets else threshold
            for distance in offsets:
                if last > reach or last >= threshold:
                    break
                last = distance
                if distance <= threshold:
                    k = distance - (at - junction)
                    tokens.append(f"{distance}.{read[k]}.{ref[k]}")
                    listed += 1
            if not listed and reach <= threshold:
                tokens.append(f"{n}M")
        if op != "D":
            read_at += n
        if op != "I":
            at += n
    return tokens


def token_error(token: str) -> tuple[str, int]:
    """(kind, length) of a token: X for a mismatch, M and 0 for none, else the operation."""
    if token.count(".") == 2:
        return "X", 1
    if token == NOTHING:
        return NOTHING, 0
    for kind in "IDMSH":
        if kind in token:
            number, rest = token.split(kind, 1)
            if rest or not number.isdigit():
                break
            return kind, int(number)
    raise ValueError(f"bad error token {token}")


def side_counts(tokens: str) -> tuple[int, int, int, int, int]:
    """Errors of one side: inserted, deleted, mismatched, soft- and hard-clipped bases."""
    totals = dict.fromkeys("IDXSH", 0)
    for token in tokens.split("_"):
        kind, n = token_error(token)
        if kind in totals:
            totals[kind] += n
    return tuple(totals.values())


def side_picture(tokens: str, threshold: int, match: str, *, before: bool) -> str:
    """One side drawn base by base: X mismatch, letters for other errors, ``match`` elsewhere; read towards the junction."""
    parts = tokens.split("_")
    drawn: list[str] = []
    place = 1  # the next base to draw; a lone "0" draws without moving it
    for token in reversed(parts) if before else parts:
        if token.count(".") == 2:
            at = int(token.split(".")[0]) + 1
            gap = max(0, at - place)
            drawn += [match] * gap + ["X"]
            place += gap + 1
        elif token == NOTHING:
            drawn += [match] * threshold
        elif "." in token:
            raise ValueError(f"bad error token {token}")
        else:
            kind, n = token_error(token)
            drawn += [match if kind == "M" else kind] * n
            place += n
    drawn += [match] * (threshold - len(drawn))
    return "".join(reversed(drawn) if before else drawn)


def density(before: list[str], after: list[str], strand: str, threshold: int, most: int, match: str = "_") -> dict:
    """Errors around each junction: how many sides exceed ``most``, which junctions (counted along the strand), and the texts."""
    if strand not in "+-" or not strand:
        raise ValueError(f"bad strand {strand}")
    sides = [(side_counts(a), side_counts(b)) for a, b in zip(before, after, strict=True)]
    over = [[sum(x) > most for x in pair] for pair in sides]
    n = len(sides)
    bad = [str(k + 1 if strand == "+" else n - k) for k, o in enumerate(over) if any(o)]
    text = lambda parts, mark: mark.join(parts) or "na"
    return {
        "bad_sides": sum(map(sum, over)),
        "junctions": ",".join(bad) or "0",
        "totals": text([f"{sum(a)}>{sum(b)}" for a, b in sides], ","),
        "profiles": text([f"{','.join(map(str, a))}>{','.join(map(str, b))}" for a, b in sides], ";"),
        "tokens": text([f"{a}>{b}" for a, b in zip(before, after, strict=True)], ";"),
        "pictures": text([f"{side_picture(a, threshold, match, before=True)}>{side_picture(b, threshold, match, before=False)}" for a, b in zip(before, after, strict=True)], ";"),
    }


def polya_window(strand: str, genome: str, start: int, end: int, window: int = POLYA_WINDOW) -> tuple[str, int, float]:
    """The genome beyond a model's 3' end, its A count and their share; model coordinates index the sequence as they are."""
    if strand == "+":
        seq = genome[max(0, end) : max(0, end + window)]
    elif strand == "-":
        seq = genome[max(0, start - window) : max(0, start)][::-1].translate(str.maketrans("ATCGNRYKMSWBDHV", "TAGCNNNNNNNNNNN"))
    else:
        raise ValueError(f"bad strand {strand}")
    return seq, seq.count("A"), seq.count("A") / max(1, len(seq))
