"""BAM files read by ranges of bytes: any number of tasks share a file, and rows and their numbers do not depend on the ranges.

A range owns the blocks that begin in it. A task finds the first of them by its magic bytes and checksum,
and the first record that begins in them by a chain of plausible records. Both are only guesses, so a first
pass walks every range from its guess and notes where its last record ends (block and offset) and how many
there are. A guess holds if it is where the range before ended; the others are walked again from the known
place until every range begins where the one before ended. The second pass decodes records from settled
places. The first pass inflates and hops from size to size; files of one range go without it.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .alignments import _MAGIC, _Bytes, bam_header, bgzf_blocks, decoded, placed_blocks, rich_alignments

SPLIT = 64 << 20
#: The largest block of the format, and records that must follow each other for a guess.
_LARGEST, _CHAIN = 1 << 16, 16


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Blocks:
    """Blocks from a place in a file on: ``at`` and inflated ``length`` of the one read last, and where the next one begins."""

    def __init__(self, file, at: int):
        self.at, self.next_at, self.length = at, at, 0
        file.seek(at)
        self._blocks = placed_blocks(file)

    def read(self) -> bytes | None:
        found = next(self._blocks, None)
        if found is None:
            return None
        self.at, self.next_at, self.length = self.next_at, self.next_at + found[0], len(found[1])
        return found[1]


@contextmanager
def _opened(path: str):
    """A file as buffered bytes; ``raw.size()`` tells its size."""
    system, inner = _system(path)
    with system.open_input_file(inner) as raw:
        yield io.BufferedReader(raw, 1 << 18)


def first_block(file, start: int, end: int, size: int) -> int | None:
    """Where the first block at or after ``start`` and before ``end`` begins; its checksum and the next block's magic must fit."""
    if start == 0:
        return 0
    file.seek(start)
    window = file.read(min(end - start, 2 * _LARGEST) + 4)
    at = window.find(_MAGIC)
    while at >= 0 and start + at < end:
        try:
            blocks = _Blocks(file, start + at)
            blocks.read()
            file.seek(blocks.next_at)
            if blocks.next_at == size or file.read(4) == _MAGIC:
                return start + at
        except (ValueError, zlib.error, struct.error):
            pass
        at = window.find(_MAGIC, at + 1)
    return None


def plausible(data: bytes, at: int, n_refs: int) -> int | None:
    """Where a record that may begin at ``at`` ends; None where its fields cannot be a record's."""
    if len(data) - at < 36:
        return None
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or 0 in name[:-1]):
        return None
    return at + 4 + size


def guess_record(data: bytes, n_refs: int) -> int | None:
    """The first offset from which plausible records follow each other to the end of ``data`` or ``_CHAIN`` times."""
    for start in range(len(data)):
        at, n = start, 0
        while at is not None and n < _CHAIN and len(data) - at >= 36:
            at, n = plausible(data, at, n_refs), n + 1
        if at is not None and n:
            return start
    return None


@dataclass(frozen=True)
class Walk:
    """A range's records: block and offset of the first one, the place after the last one, and how many."""

    block: int
    offset: int
    end_block: int
    end_offset: int
    records: int


def _raw_records(file, block: int, offset: int, end: int, n_refs: int | None = None) -> Iterator[tuple[bytes, tuple[int, int]]]:
    """Records that begin in blocks before ``end``, from a place on, each with the place after it.

    The place after a record that fills its block is the next block's first byte. A file has to end with an empty block.
    With ``n_refs``, for guessed places, a record whose fields cannot be one's is an error before its rest is read.
    """
    blocks = _Blocks(file, block)
    data = (blocks.read() or b"")[offset:]
    if not blocks.length:
        return
    while True:
        while not data:
            if blocks.next_at >= end:
                if end >= file.raw.size():
                    raise ValueError("BGZF stream ends without its end block")
                return
            data = blocks.read()
            if not data:
                return
        if blocks.at >= end:
            return
        while len(data) < 36:
            more = blocks.read()
            if not more:
                raise ValueError("BAM record is cut short")
            data += more
        size = 4 + struct.unpack_from("<i", data)[0]
        if size < 36 or n_refs is not None and plausible(data, 0, n_refs) is None:
            raise ValueError("not a BAM record")
        parts, held = [data], len(data)
        while held < size:
            parts.append(blocks.read())
            if not parts[-1]:
                raise ValueError("BAM record is cut short")
            held += len(parts[-1])
        data = b"".join(parts)
        raw, data = data[4:size], data[size:]
        yield raw, (blocks.at, blocks.length - len(data)) if data else (blocks.next_at, 0)


def walk_range(file, size: int, start: int, end: int, n_refs: int, known: tuple[int, int] | None) -> Walk | None:
    """A range's records from a ``known`` place or a guess; None if it is guessed that none begins in it."""
    guessed = known is None
    if guessed:
        block = first_block(file, start, end, size)
        if block is None:
            return None
        blocks = _Blocks(file, block)
        data = b""
        while len(data) < 4 * _LARGEST and (more := blocks.read()):
            data += more
        offset = guess_record(data, n_refs)
        if offset is None:
            return None
        at = _Blocks(file, block)  # from an offset in joined blocks to a block's own
        own = at.read()
        while offset >= len(own):
            offset -= len(own)
            own = at.read()
        known = at.at, offset
    place, n = known, 0
    if known[0] < end:
        for _, place in _raw_records(file, *known, end, n_refs if guessed else None):  # noqa: B007
            n += 1
    return Walk(*known, *place, n)


def _header(file) -> tuple[list[str], tuple[int, int]]:
    """Names of the sequences, and the place of the first record."""
    blocks = _Blocks(file, 0)
    data = _Bytes(iter(blocks.read, b""))
    names = bam_header(data)
    return names, ((blocks.at, blocks.length - len(data.held)) if data.held else (blocks.next_at, 0))


_WALKS = "path string, part long, start long, stop long, block long, offset long, end_block long, end_offset long, records long, failed string"


def _walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            with _opened(r.path) as file:
                found = failed = None
                try:
                    names, first = _header(file)
                    known = first if r.part == 0 else (int(r.block), int(r.offset)) if r.block >= 0 else None
                    found = walk_range(file, file.raw.size(), int(r.start), int(r.stop), len(names), known)
                except (ValueError, zlib.error, struct.error) as wrong:  # a wrong guess may lead anywhere; a known place may not
                    failed = str(wrong)
            cells = (found.block, found.offset, found.end_block, found.end_offset, found.records) if found else (int(r.block), int(r.offset), -1, -1, 0)
            out.append((r.path, r.part, r.start, r.stop, *cells, failed))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _WALKS.split(", ")])


def _one_by_one(spark: SparkSession, rows: list[tuple]) -> list:
    """The walks of (path, part, start, stop, block, offset) rows, one a task."""
    df = spark.createDataFrame(rows, "path string, part long, start long, stop long, block long, offset long").repartition(len(rows), "path", "part")
    return df.mapInPandas(_walked, _WALKS).collect()


def settled_ranges(spark: SparkSession, paths: list[str], split: int) -> list[tuple]:
    """(path, stop, block, offset, first number) of every range that has records; one small row a range is all that the driver sees."""
    ranges, out = {}, []
    for path in paths:
        system, inner = _system(path)
        size = system.get_file_info(inner).size
        if size <= split:
            out.append((path, size, -1, -1, 1))
        else:
            ranges[path] = [(path, k, a, min(size, a + split)) for k, a in enumerate(range(0, size, split))]
    todo = [(*r, -1, -1) for rows in ranges.values() for r in rows]
    walks: dict[tuple[str, int], object] = {}
    while todo:
        walks |= {(w.path, w.part): w for w in _one_by_one(spark, todo)}
        todo = []
        for path, rows in ranges.items():
            place = None
            for _, k, a, stop in rows:
                w = walks[path, k]
                if place is None or place == (w.block, w.offset):
                    if w.failed:
                        raise ValueError(f"{path}: {w.failed}")
                    place = (w.end_block, w.end_offset)
                elif place[0] < stop:
                    todo.append((path, k, a, stop, *place))  # all later ranges may still hold; they are looked at again
                    break
    for path, rows in ranges.items():
        number, place = 1, None
        for _, k, _, stop in rows:
            w = walks[path, k]
            if place is None or place == (w.block, w.offset):
                if w.records:
                    out.append((path, stop, w.block, w.offset, number))
                number, place = number + w.records, (w.end_block, w.end_offset)
        if place[0] >= rows[-1][3]:
            raise ValueError(f"{path}: BGZF stream ends without its end block")
    return out


class _Range(InputPartition):
    def __init__(self, path: str, stop: int, block: int, offset: int, number: int):
        self.path, self.stop, self.block, self.offset, self.number = path, stop, block, offset, number


class _RangeReader(DataSourceReader):
    def __init__(self, ranges: list[list]):
        self.ranges = ranges

    def partitions(self) -> list[_Range]:
        return [_Range(*r) for r in self.ranges]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with _opened(partition.path) as file:
            names, _ = _header(file)
            if partition.block < 0:
                file.seek(0)
                data = _Bytes(bgzf_blocks(file))
                bam_header(data)
                raws = iter(lambda: data.take(struct.unpack("<i", size)[0]) if (size := data.take(4, may_end=True)) is not None else None, None)
            else:
                raws = (raw for raw, _ in _raw_records(file, partition.block, partition.offset, partition.stop))
            for number, raw in enumerate(raws, partition.number):
                yield partition.path, number, *decoded(raw, names)


class BamSource(DataSource):
    """``bam``: decoded BAM records, one partition a settled range."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "path string, line long, qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, tags map<string,string>"

    def reader(self, schema) -> _RangeReader:
        return _RangeReader(json.loads(self.options["ranges"]))


def read_bam(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """BAM files with the rich reader's columns; files larger than ``split`` bytes are shared by several tasks."""
    spark.dataSource.register(BamSource)
    ranges = settled_ranges(spark, list(paths), split)
    return rich_alignments(spark.read.format("bam").option("ranges", json.dumps(ranges)).load())
