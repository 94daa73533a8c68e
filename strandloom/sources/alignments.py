"""Alignments from SAM text, and the records of BAM streams."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from .lines import columns, numbered_lines, whole_number

#: The flags the strict reader knows, and their classes.
CLASSES = {0: "forward", 16: "reverse", 4: "unmapped", 2048: "chimeric", 2064: "chimeric", 256: "not_primary", 272: "not_primary"}


def sam_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Record lines: blank lines and header lines left out."""
    return numbered_lines(spark, *paths).where((F.trim("text") != "") & ~F.col("text").startswith("@"))


def _tags(fields: Column) -> Column:
    parts = F.filter(F.slice(fields, 12, F.greatest(F.size(fields) - 11, F.lit(0))), lambda t: F.substring(t, 3, 1) == ":")
    pairs = F.transform(parts, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 6, 1 << 30).alias("v")))
    return pairs


def read_sam(spark: SparkSession, *paths: str) -> DataFrame:
    """The strict reader: qname, flag, class, rname, pos, cigar, seq, xs; any other flag is an error.

    ``xs`` is the value of the last XS:A tag.
    """
    rows = columns(sam_lines(spark, *paths), at_least=11, what="a SAM record")
    flag = whole_number(F.col("f")[1], "flag").cast("int")
    kind = F.lit(None).cast("string")
    for value, name in CLASSES.items():
        kind = F.when(F.col("flag") == value, F.lit(name)).otherwise(kind)
    unknown = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": unknown flag "), F.col("flag").cast("string"))
    xs = F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: t.startswith("XS:A:"))
    out = rows.select("path", "line", F.col("f")[0].alias("qname"), flag.alias("flag"), F.col("f")[2].alias("rname"), whole_number(F.col("f")[3], "position").alias("pos"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.when(F.size(xs) > 0, F.substring(F.element_at(xs, -1), 6, 1)).alias("xs"))
    return out.withColumn("class", F.when(kind.isNull(), F.raise_error(unknown)).otherwise(kind))


def rich_alignments(rows: DataFrame) -> DataFrame:
    """Adds ops, start, end and query bounds (half-open) to (qname, flag, rname, pos, mapq, cigar, seq, tags).

    ``H`` and ``P`` count for nothing; unmapped rows end where they start.
    """
    kept = F.filter(C.operations(F.col("cigar"), merge_matches=False), lambda o: ~o["op"].isin("H", "P"))
    rows = rows.withColumn("ops", kept).withColumn("start", F.col("pos") - 1)
    unmapped = (F.col("flag").bitwiseAND(4) != 0) | (F.col("rname") == "*")
    lead = F.when(F.element_at("ops", 1)["op"] == "S", F.element_at("ops", 1)["len"]).otherwise(F.lit(0))
    rows = rows.withColumn("end", F.when(unmapped, F.col("start")).otherwise(F.col("start") + C.reference_span(F.col("ops"))))
    rows = rows.withColumn("query_start", F.when(F.size("ops") > 0, lead).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("query_end", F.col("query_start") + C.query_length(F.col("ops"))).withColumn("unmapped", unmapped | (F.col("end") <= F.col("start")))


def read_sam_rich(spark: SparkSession, *paths: str) -> DataFrame:
    """The rich reader: all two-letter tags as a map (the last of a name wins), ``*`` sequences empty."""
    f = F.col("f")
    rows = columns(sam_lines(spark, *paths), at_least=11, what="a SAM record")
    tags = F.aggregate(_tags(f), F.expr("CAST(map() AS map<string,string>)"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != t["k"]), F.create_map(t["k"], t["v"])))
    out = rows.select("path", "line", f[0].alias("qname"), whole_number(f[1], "flag").cast("int").alias("flag"), f[2].alias("rname"), whole_number(f[3], "position").alias("pos"), whole_number(f[4], "mapping quality").cast("int").alias("mapq"), f[5].alias("cigar"), F.when(f[9] == "*", "").otherwise(f[9]).alias("seq"), tags.alias("tags"))
    return rich_alignments(out)


def sam_to_bed(alignments: DataFrame) -> DataFrame:
    """Primary, placed alignments as BED12 columns: exons of M and D, score the mapping quality."""
    kept = alignments.where((F.col("flag").bitwiseAND(0x904) == 0) & (F.col("pos") > 0) & (F.col("cigar") != "*"))
    exons = C.exons_of(F.col("pos") - 1, F.col("cigar"))
    rows = kept.withColumn("exons", F.filter(exons, lambda e: e["end"] > e["start"]))
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    return rows.select(F.col("rname").alias("chrom"), F.element_at("exons", 1)["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), F.col("qname").alias("name"), F.col("mapq").cast("string").alias("score"), strand.alias("strand"), "exons")


# --- BAM -------------------------------------------------------------------------------------

_MAGIC = b"\x1f\x8b\x08\x04"
_SEQ, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_FIXED = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def bgzf_blocks(stream) -> Iterator[bytes]:
    """The inflated blocks of a BGZF stream; a stream cut short is an error."""
    for _, data in placed_blocks(stream):
        if not data:
            return
        yield data
    raise ValueError("BGZF stream ends without its end block")


def placed_blocks(stream) -> Iterator[tuple[int, bytes]]:
    """(size in the file, inflated bytes) of each block of a BGZF stream up to its end."""
    while head := stream.read(18):
        if len(head) < 18 or head[:4] != _MAGIC:
            raise ValueError("not a BGZF block")
        extra = struct.unpack_from("<H", head, 10)[0]
        field = head[12:18] + stream.read(extra - 6)
        at, size = 0, None
        while at + 4 <= len(field):
            tag, n = field[at : at + 2], struct.unpack_from("<H", field, at + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", field, at + 4)[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("BGZF block without its size")
        body = stream.read(size - 12 - extra)
        if len(body) < size - 12 - extra:
            raise ValueError("BGZF block is cut short")
        data = zlib.decompress(body[:-8], -15)
        if zlib.crc32(data) != struct.unpack_from("<I", body, len(body) - 8)[0]:
            raise ValueError("BGZF block fails its checksum")
        yield size, data


class _Bytes:
    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def take(self, n: int, *, may_end: bool = False) -> bytes | None:
        while len(self.held) < n:
            block = next(self.blocks, None)
            if block is None:
                if may_end and not self.held:
                    return None
                raise ValueError("BAM record is cut short")
            self.held += block
        out, self.held = self.held[:n], self.held[n:]
        return out


def _bam_tags(raw: bytes) -> dict[str, str]:
    tags, at = {}, 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            tags[name] = raw[at:end].decode()
            at = end + 1
        elif kind == "A":
            tags[name] = chr(raw[at])
            at += 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            values = [struct.unpack_from(_FORMS[sub], raw, at + 5 + k * _FIXED[sub])[0] for k in range(n)]
            tags[name] = ",".join([sub, *map(str, values)])
            at += 5 + n * _FIXED[sub]
        else:
            tags[name] = str(struct.unpack_from(_FORMS[kind], raw, at)[0])
            at += _FIXED[kind]
    return tags


def bam_header(data: _Bytes) -> list[str]:
    """The names of the sequences, with ``data`` left at the first record."""
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    data.take(struct.unpack("<i", data.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", data.take(4))[0]):
        names.append(data.take(struct.unpack("<i", data.take(4))[0])[:-1].decode())
        data.take(4)
    return names


def decoded(raw: bytes, names: list[str]) -> tuple:
    """(qname, flag, rname, pos, mapq, cigar, seq, tags) of a record without its size."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
    at = 32
    qname = raw[at : at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    packed = raw[at : at + (n_seq + 1) // 2]
    at += len(packed) + n_seq
    seq = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in packed)[:n_seq]
    cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*"
    return qname, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, seq, _bam_tags(raw[at:])


def bam_records(stream) -> Iterator[tuple]:
    """(qname, flag, rname, pos, mapq, cigar, seq, tags) of a BAM stream."""
    data = _Bytes(bgzf_blocks(stream))
    names = bam_header(data)
    while (size := data.take(4, may_end=True)) is not None:
        yield decoded(data.take(struct.unpack("<i", size)[0]), names)
