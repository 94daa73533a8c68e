import io
import random
import struct
import zlib

import pytest

from strandloom.sources import bam_ranges
from strandloom.sources.alignments import bam_records


def block(part, level=6):
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(part) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def record(name, pos, inside=b""):
    n = 10 + pos % 7
    tags = b"ZBBc" + struct.pack("<i", len(inside)) + inside if inside else b"CBZAA\0"
    raw = struct.pack("<iiBBHHHiiii", pos % 2, pos, len(name) + 1, 60, 0, 1, 0, n, -1, -1, 0) + name + b"\0" + struct.pack("<I", n << 4) + bytes([0x12]) * ((n + 1) // 2) + b"\xff" * n + tags
    return struct.pack("<i", len(raw)) + raw


def bam_file(records, width, level=6, rng=None, end=True):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + struct.pack("<i", 9999) for n in (b"chr1\0", b"chr2\0"))
    data, out, at = head + b"".join(records), b"", 0
    while at < len(data):
        n = rng.randrange(1, 2 * width) if rng else width
        out += block(data[at : at + n], level)
        at += n
        if rng and rng.random() < 0.1 and level:
            out += block(data[at : at + 1], 9) if at < len(data) else b""
            at += 1
    return out + (block(b"") if end else b"")


def walked(content, split, tmp_path):
    """What the tasks do, without Spark: walks from guesses, walks from known places, rows."""
    path = tmp_path / f"w{split}.bam"
    path.write_bytes(content)
    out, place, wrong = [], None, 0
    with bam_ranges._opened(str(path)) as file:
        names, first = bam_ranges._header(file)
        for k, a in enumerate(range(0, len(content), split)):
            stop = min(len(content), a + split)
            if k:
                try:
                    guess = bam_ranges.walk_range(file, len(content), a, stop, len(names), None)
                except (ValueError, zlib.error, struct.error):
                    guess = None
                wrong += place[0] < stop and (guess is None or (guess.block, guess.offset) != place)
            if k == 0 or place[0] < stop:
                w = bam_ranges.walk_range(file, len(content), a, stop, len(names), first if k == 0 else place)
                out += [bam_ranges.decoded(raw, names) for raw, _ in bam_ranges._raw_records(file, w.block, w.offset, stop)] if w.records else []
                place = w.end_block, w.end_offset
    return out, wrong


def test_any_range_gives_the_same_records(tmp_path):
    rng = random.Random(2)
    content = bam_file([record(b"r%d" % k * rng.randrange(1, 9), rng.randrange(5000)) for k in range(400)], 150, rng=rng)
    expected = list(bam_records(io.BytesIO(content)))
    assert len(expected) == 400
    for split in (97, 500, 3333, len(content)):
        found, wrong = walked(content, split, tmp_path)
        assert found == expected and wrong <= (len(content) // split) // 5


def hostile():
    """Stored blocks whose arrays hold whole blocks and chains of records."""
    fake = block(b"".join(record(b"fake", k) for k in range(40)), 0) * 3
    chain = b"".join(record(b"trap", k) for k in range(60))
    rows = []
    for k in range(60):
        rows.append(record(b"real%d" % k, k, inside=(b"", fake, chain)[k % 3]))
    return bam_file(rows, 1 << 15, level=0)


def test_records_inside_records_mislead_the_guess_only(tmp_path):
    content = hostile()
    expected = list(bam_records(io.BytesIO(content)))
    wrongs = 0
    for split in (4000, 9000, 40_000):
        found, wrong = walked(content, split, tmp_path)
        assert found == expected
        wrongs += wrong
    assert wrongs


@pytest.mark.parametrize("split", [3000, 20_000])
def test_ranges_of_several_files_in_spark(spark, tmp_path, split):
    rng = random.Random(4)
    files = {"a.bam": hostile(), "b.bam": bam_file([record(b"r%d" % k, k) for k in range(300)], 400, rng=rng), "none.bam": bam_file([], 40), "c.bam": bam_file([record(b"one", 3)], 40)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    df = bam_ranges.read_bam(spark, *(str(tmp_path / n) for n in files), split=split)
    got = sorted((r.path.rsplit("/", 1)[1], r.line, r.qname, r.flag, r.rname, r.pos, r.mapq, r.cigar, r.seq, r.tags) for r in df.collect())
    expected = sorted((name, k, *row) for name, content in files.items() for k, row in enumerate(bam_records(io.BytesIO(content)), 1))
    key = lambda rows: [(*r[:-1], tuple(sorted(r[-1].items()))) for r in rows]
    assert key(got) == key(expected)
    assert df.rdd.getNumPartitions() > len(files)


@pytest.mark.parametrize("cut", [28, 60, 700])
def test_a_cut_file_is_an_error(spark, tmp_path, cut):
    content = bam_file([record(b"r%d" % k, k) for k in range(300)], 400, rng=random.Random(4))
    (tmp_path / "a.bam").write_bytes(content[:-cut])
    with pytest.raises(ValueError, match="a.bam: .*(end block|cut short)"):
        bam_ranges.read_bam(spark, str(tmp_path / "a.bam"), split=2000)
