"""Sequence and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers before a gene name inside a joined transcript name, in order of precedence.
GENE_MARKERS = ("_chr", "_XM", "_XR", "_NM", "_NR", "_R2_")


def reverse_complement(seq: Column, *, other: str = "keep_case") -> Column:
    """Reverse complement. ``keep_case``: letters keep their case, others become N; ``strict``: others are an error."""
    if other == "strict":
        return F.when(seq.rlike("[^ACGTN]"), F.raise_error(F.concat(F.lit("not a base: "), seq))).otherwise(F.reverse(F.translate(seq, "ACGTN", "TGCAN")))
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def longest_run(seq: Column, letter: str) -> Column:
    """Length of the longest run of a letter, case aside."""
    runs = F.regexp_extract_all(F.upper(seq), F.lit(f"({letter.upper()}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")


def last_token(name: Column, separator: str = "_") -> Column:
    return F.substring_index(name, separator, -1)


def split_name(name: Column) -> tuple[Column, Column]:
    """(transcript, gene) of a joined name: at the last marker of the first kind found, else the last underscore, else both the whole."""
    transcript, gene = F.when(name.contains("_"), F.regexp_extract(name, r"(?s)^(.*)_", 1)).otherwise(name), last_token(name)
    for marker in reversed(GENE_MARKERS):
        found = name.contains(marker)
        transcript = F.when(found, F.regexp_extract(name, f"(?s)^(.*){marker}", 1)).otherwise(transcript)
        gene = F.when(found, F.concat(F.lit(marker[1:]), F.substring_index(name, marker, -1))).otherwise(gene)
    return transcript, gene


def without_novel_suffix(name: Column) -> Column:
    """The name without its first ``_digits`` or ``-digits``."""
    return F.regexp_replace(name, r"(?s)^(.*?)[_-][0-9]+", "$1")


def joined_once(name: Column) -> Column:
    """The name with its first ``;`` as an underscore."""
    return F.regexp_replace(name, r"(?s)^([^;]*);", "$1_")


def attribute(attributes: Column, key: str) -> Column:
    """A quoted attribute of a GTF column; null where it is missing."""
    value = F.regexp_extract(attributes, rf'(?:^|;)\s*{key}\s+"([^"]*)"', 1)
    return F.when(attributes.rlike(rf'(?:^|;)\s*{key}\s+"'), value)


def read_identity(qname: Column, cell: Column, molecule: Column, platform: str, *, sample: Column | None = None) -> Column:
    """The key that tells molecules apart: cell and molecule tags; fields of the read name; or the read itself."""
    if platform == "10x":
        return F.when(cell.isNotNull() & molecule.isNotNull(), F.concat_ws("_", cell, molecule))
    if platform == "parse":
        parts = F.split(qname, "_")
        n = F.size(parts)
        barcode = F.concat_ws("_", F.slice(parts, F.greatest(n - 4, F.lit(1)), 3))
        return F.when(n >= 5, F.concat_ws("_", barcode, F.element_at(parts, -1)))
    return F.concat_ws("_", F.translate(qname, ":", "."), sample if sample is not None else F.lit("bulk"))


def block_lists(exons: Column, start: Column) -> tuple[Column, Column]:
    """Block sizes and relative starts of a BED12 row, as comma lists."""
    sizes = F.array_join(F.transform(exons, lambda e: (e["end"] - e["start"]).cast("string")), ",")
    starts = F.array_join(F.transform(exons, lambda e: (e["start"] - start).cast("string")), ",")
    return sizes, starts


def joined_pieces(pieces: Column) -> Column:
    """Half-open (start, end) pieces as ascending exons: a piece that begins where the last ends is joined to it."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    piece = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))

    def add(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(piece(last["start"], F.greatest(last["end"], p["end"]))))
        return F.when(last["end"] == p["start"], grown).otherwise(F.concat(out, F.array(piece(p["start"], p["end"]))))

    return F.aggregate(F.array_sort(pieces), empty, add)
