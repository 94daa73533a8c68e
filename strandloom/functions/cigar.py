"""CIGAR expressions: parsing, exons, spans and blocks, folded inside Catalyst; exons of whole texts by one Arrow kernel a batch.

An operation is a struct (len, op). ``=`` and ``X`` count as ``M`` unless a function says otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

_OPS = r"(\d+)([A-Za-z])"
EXONS = "array<struct<start:bigint,end:bigint>>"


def operations(cigar: Column, *, merge_matches: bool = True) -> Column:
    """The array of (len, op); a CIGAR of ``*`` or nothing gives none. A letterless rest is an error."""
    text = F.translate(cigar, "=X", "MM") if merge_matches else cigar
    parts = F.regexp_extract_all(text, F.lit(_OPS), F.lit(0))
    ops = F.transform(parts, lambda p: F.struct(p.substr(F.lit(1), F.length(p) - 1).cast("long").alias("len"), F.substring(p, -1, 1).alias("op")))
    bad = text.rlike(r"\d$")
    return F.when(bad, F.raise_error(F.concat(F.lit("CIGAR ends with a length: "), cigar))).otherwise(ops)


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda n, o: n + F.when(o["op"].isin(*kinds), o["len"]).otherwise(F.lit(0)))


def mapped_length(ops: Column) -> Column:
    """Bases of M and D."""
    return _total(ops, "MD")


def query_length(ops: Column) -> Column:
    """Aligned query bases: M, =, X and I."""
    return _total(ops, "M=XI")


def reference_span(ops: Column) -> Column:
    """Reference bases from first to last: M, D, N, = and X."""
    return _total(ops, "MDN=X")


def clipped(ops: Column, kind: str) -> Column:
    return _total(ops, kind)


def exons(start: Column, ops: Column) -> Column:
    """Stretches of M and D split at N, from ``start`` on: array of (start, end), end exclusive.

    N always closes the exon before it; the last exon closes at the end.
    """
    empty = F.expr(f"CAST(array() AS {EXONS})")
    first = F.struct(empty.alias("done"), start.cast("long").alias("from"), start.cast("long").alias("at"))

    def step(acc: Column, o: Column) -> Column:
        moved = acc["at"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["len"]).otherwise(F.lit(0))
        closed = F.array_append(acc["done"], F.struct(acc["from"].alias("start"), acc["at"].alias("end")))
        return F.struct(F.when(o["op"] == "N", closed).otherwise(acc["done"]).alias("done"), F.when(o["op"] == "N", moved).otherwise(acc["from"]).alias("from"), moved.alias("at"))

    return F.aggregate(ops, first, step, lambda acc: F.array_append(acc["done"], F.struct(acc["from"].alias("start"), acc["at"].alias("end"))))


def exon_lists(starts: pa.Array, cigars: pa.Array) -> pa.Array:
    """``exons`` of a batch: digits, operations and running offsets of all its texts at once; null where a text or a start is."""
    texts = cigars.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(bounds[0]) if len(texts) else 0
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[low : int(bounds[-1])] if len(texts) else np.zeros(0, np.uint8)
    bounds = bounds - low
    digit = (raw >= 48) & (raw <= 57)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    if digit[last].any():
        row = int(np.searchsorted(bounds, last[digit[last]][0], "right")) - 1
        raise ValueError(f"CIGAR ends with a length: {cigars[row].as_py()}")
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw == ord("="))
    at = np.flatnonzero(letter[1:] & digit[:-1]) + 1  # a text's last byte is no digit, so no length runs on into the next text
    before = np.maximum.accumulate(np.where(digit, -1, np.arange(len(raw))))
    first = before[at - 1] + 1
    if len(at) and (at - first).max() > 18:
        raise ValueError("a CIGAR length has more than 18 digits")
    length = np.zeros(len(at), dtype=np.int64)
    for k in range(int((at - first).max()) if len(at) else 0):
        more = first + k < at
        length[more] = length[more] * 10 + (raw[first[more] + k] - 48)
    row = np.searchsorted(bounds, at, "right") - 1
    op = raw[at]
    moved = np.where(np.isin(op, np.frombuffer(b"MDN=X", dtype=np.uint8)), length, 0)
    after = np.concatenate([[0], np.cumsum(moved)])
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    start = starts.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    base = start - after[edges[:-1]]
    cut = np.flatnonzero(op == ord("N"))
    counts = 1 + np.bincount(row[cut], minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    ends_at = np.cumsum(counts)
    low_at, high_at = np.ones(int(counts.sum()), bool), np.ones(int(counts.sum()), bool)
    low_at[ends_at - counts] = high_at[ends_at - 1] = False
    lows, highs = np.empty(len(low_at), np.int64), np.empty(len(low_at), np.int64)
    lows[~low_at], highs[~high_at] = start, base + after[edges[1:]]
    lows[low_at], highs[high_at] = base[row[cut]] + after[cut + 1], base[row[cut]] + after[cut]
    offsets = np.concatenate([[0], ends_at]).astype(np.int32)
    known = np.asarray(cigars.is_valid()) & np.asarray(starts.is_valid())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(lows), pa.array(highs)], ["start", "end"]), mask=pa.array(~known))


_exon_lists = F.arrow_udf(exon_lists, ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))


def exons_of(start: Column, cigar: Column) -> Column:
    """``exons`` of a CIGAR text: stretches of M, D, = and X split at N, from ``start`` on."""
    return _exon_lists(start.cast("long"), cigar)


def introns(exon_array: Column) -> Column:
    """Gaps between consecutive exons: array of (start, end)."""
    n = F.size(exon_array)
    return F.zip_with(F.slice(exon_array, 1, F.greatest(n - 1, F.lit(0))), F.slice(exon_array, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))


def coverage_percent(length: Column, hard: Column, soft: Column) -> Column:
    """Share of the read that aligned: (length - hard - soft) / length, in percent."""
    return F.when(length > 0, (length - hard - soft) / length * 100.0)


def identity_percent(length: Column, hard: Column, soft: Column, insertions: Column, deletions: Column, mismatches: Column, *, over_read: bool) -> Column:
    """Identity in percent: over the whole read, where clips count as errors, or over its unclipped part."""
    errors = insertions + deletions + mismatches
    base = length if over_read else length - hard - soft
    return F.when(base != 0, (base - errors - (hard + soft if over_read else F.lit(0))) / base * 100.0)
