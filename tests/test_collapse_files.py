import random
from collections import defaultdict

import pytest

from strandloom.operators.collapse import ReadSettings
from strandloom.sinks import collapse, files
from strandloom.sources import alignments, annotations


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    """Two genes: a spliced one with a shared mismatch, a clipped group, and one before a stretch of A; rejects of each kind."""
    at = tmp_path_factory.mktemp("collapse")
    rng = random.Random(5)
    genome = "".join(rng.choice("CGT") for _ in range(1200))
    genome = genome[:1100] + "A" * 20 + genome[1120:]
    (at / "g.fa").write_text(f">c\n{genome}\n")
    rows = []

    def add(name, flag, pos, cigar, seq, *tags):
        rows.append("\t".join([name, str(flag), "c" if flag != 4 else "*", str(pos), "60", cigar, "*", "0", "0", seq, "*", *tags]))

    spliced = genome[100:200] + genome[300:400]
    add("lost", 4, 0, "*", "ACGT")
    add("far", 2048, 101, "10M", genome[100:110])
    for k in range(6):
        add(f"r{k}", 0, 101, "100M100N100M", spliced, *(["XS:A:-"] if k == 2 else []))
    changed = spliced[:150] + ("G" if spliced[150] != "G" else "C") + spliced[151:]
    for k in range(5):
        add(f"v{k}", 0, 101, "100M100N100M", changed)
    add("clipped", 0, 101, "50S100M", "A" * 50 + genome[100:200])
    add("tail", 0, 901, "200M", genome[900:1100])
    (at / "a.sam").write_text("\n".join(rows) + "\n")
    reads, fasta = alignments.read_sam(spark, str(at / "a.sam")), annotations.read_fasta(spark, str(at / "g.fa"))
    return collapse.collapsed(reads, fasta, ReadSettings()), fasta, at


def test_ten_files_read_back(spark, sample):
    found, fasta, at = sample
    names = collapse.write_collapse(found, fasta, str(at / "out"), "s", parameters="-x capped")
    assert len(names) == 10
    text = {}
    for name in names:
        files.join_parts(spark, str(at / "out"), name, str(at / f"{name}.one"))
        text[name[1:]] = (at / f"{name}.one").read_text().splitlines()
    assert text["_read.txt"][:3] == [collapse.HEADERS["_read.txt"], "lost\tunmapped\tunmapped\tNA\tNA\tNA\tNA\tNA", "far\tchimeric\tchimeric\tNA\tNA\tNA\tNA\tNA"]
    verdicts = {r.split("\t")[0]: r.split("\t")[1:5] for r in text["_read.txt"][3:]}
    assert verdicts["r0"] == ["forward_strand", "accepted", "100.0", "100.0"] and verdicts["v0"] == ["forward_strand", "accepted", "100.0", "99.5"]
    assert verdicts["clipped"][:3] == ["forward_strand", "discarded", "66.67"]
    assert text[".bed"] == ["c\t100\t400\tG1;G1.1\t40\t+\t100\t400\t255,0,0\t2\t100,100\t0,200", "c\t900\t1100\tG2;G2.1\t40\t+\t900\t1100\t255,0,0\t1\t200\t0"]
    assert [r.split("\t")[3] for r in text["_trans_read.bed"]] == [f"G1.1;{k}{i}" for k, n in (("r", 6), ("v", 5)) for i in range(n)] + ["G2.1;tail"]
    assert text["_trans_report.txt"][1:] == ["G1.1\t11\t100.0\t100.0\t100.0\t99.5\t0,0\t0,0\t0,0\t0,0\t0>0", "G2.1\t1\t100.0\t100.0\t100.0\t100.0\t0\t0\t0\t0\tna"]
    (polya,) = text["_polya.txt"][1:]
    assert polya.split("\t")[:3] == ["tail", "G2.1", "+"] and float(polya.split("\t")[3]) > 70
    assert text["_strand_check.txt"][1:] == ["r2\tc\t101\t100M100N100M\t+-"]
    density = [r.split("\t") for r in text["_local_density_error.txt"]]
    assert len(density) == 13 and {len(r) for r in density} == {13} and density[1][:7] == ["r0", "lde_pass", "c", "101", "401", "+", "2"]
    (variant,) = [r.split("\t") for r in text["_variants.txt"][1:]]
    assert variant[:3] + variant[5:] == ["c", "350", "M", "5", "11", "v0,v1,v2,v3,v4"]
    assert text["_varcov.txt"][1:] == ["c_350\t" + ",".join([*(f"r{k}" for k in range(6)), *(f"v{k}" for k in range(5))])]
    assert text["_report.txt"] == ["Collapse has run successfully!", "Parameters used:\t-x capped", "Total Gene Count:\t2", "Total Transcript Count:\t2", "Total Accepted Reads:\t12", "Total Discarded Reads:\t3"]


def test_without_variants_two_files_stay_away(sample):
    found, fasta, at = sample
    names = collapse.write_collapse(found, fasta, str(at / "bare"), "s", variants=False)
    assert len(names) == 8 and not {"s_variants.txt", "s_varcov.txt"} & {p.name for p in (at / "bare").iterdir()}


def test_cover_and_support_equal_a_scan_of_places(spark):
    rng = random.Random(3)
    reads, events = [], []
    for k in range(40):
        start = rng.randrange(1, 60)
        parts = [(start, start + 20), (start + 30, start + 45)]
        reads.append(("c", f"q{k:02}", [a for a, _ in parts], [b for _, b in parts]))
        events += [(f"q{k:02}", rng.randrange(0, 12) * 10, rng.choice("HSMID"), rng.choice("AC")) for _ in range(4)]
    kept = [r for r in reads if rng.random() < 0.7]
    by_read = defaultdict(list)
    for name, pos, kind, seq in events:
        by_read[name].append((pos, kind, seq))
    event = "array<struct<pos:bigint,kind:string,seq:string>>"
    judged = spark.createDataFrame([("c", r[1], by_read[r[1]]) for r in reads], f"scaffold string, read_id string, events {event}")
    accepted = spark.createDataFrame(kept, "scaffold string, read_id string, starts array<long>, ends array<long>")
    genome = "".join(rng.choice("ACGT") for _ in range(105))
    fasta = spark.createDataFrame([("c", genome)], "id string, seq string")
    found = collapse.Collapsed(judged, judged, accepted, judged)
    got = [(r.file, r.line) for r in collapse.variant_lines(found, fasta, least=3).orderBy("file", "second", "third", "sub").collect()]
    told = defaultdict(set)
    for name, pos, kind, seq in events:
        told[pos, kind, seq].add(name)
    over = lambda pos: sorted({r[1] for r in kept for a, b in zip(r[2], r[3], strict=True) if a <= pos < b} | {n for (p, _, _), ns in told.items() if p == pos for n in ns})
    lines, sets = [], defaultdict(list)
    for pos in sorted({p for p, _, _ in told if p < len(genome)}):
        strong = sorted((("HSMID".index(k), k, s, ns) for (p, k, s), ns in told.items() if p == pos and len(ns) >= 3))
        clipped = any(k in "HS" for p, k, _ in told if p == pos)
        lines += [f"c\t{pos}\t{k}\t{genome[pos] if k == 'M' and not clipped else 'NA'}\t{s}\t{len(ns)}\t{len(over(pos))}\t{','.join(sorted(ns))}" for _, k, s, ns in strong]
        if strong:
            sets[",".join(over(pos))].append(f"c_{pos}")
    assert [line for f, line in got if f == "_variants.txt"] == lines and len(lines) > 5
    assert sorted(line for f, line in got if f == "_varcov.txt") == sorted(f"{','.join(sorted(v))}\t{k}" for k, v in sets.items())
