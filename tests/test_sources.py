import struct
import zlib

import pytest
from pyspark.errors import PySparkException

from strandloom.sinks import text as sinks
from strandloom.sources import alignments, annotations, bam_ranges


def write(path, content):
    path.write_text(content)
    return str(path)


SAM = "@HD\tx\n" + "\n".join("\t".join(r) for r in [
    ["r1", "0", "chr1", "7", "60", "4S6M2D3N5M", "*", "0", "0", "ACGTACGTACGTACG", "*", "XS:A:+", "CB:Z:AA", "UB:Z:CC", "XS:A:-"],
    ["r2", "16", "chr1", "3", "9", "5M", "*", "0", "0", "*", "*"],
    ["r3", "4", "*", "0", "0", "*", "*", "0", "0", "AC", "*"],
    ["r4", "256", "chr1", "9", "1", "3M", "*", "0", "0", "ACG", "*"],
]) + "\n\n"


def test_sam_readers(spark, tmp_path):
    path = write(tmp_path / "a.sam", SAM)
    strict = {r.qname: r for r in alignments.read_sam(spark, path).collect()}
    assert [(strict[q]["class"], strict[q].pos, strict[q].xs) for q in ("r1", "r2", "r3", "r4")] == [("forward", 7, "-"), ("reverse", 3, None), ("unmapped", 0, None), ("not_primary", 9, None)]
    rich = {r.qname: r for r in alignments.read_sam_rich(spark, path).collect()}
    assert (rich["r1"].start, rich["r1"].end, rich["r1"].query_start, rich["r1"].query_end) == (6, 22, 4, 15)
    assert rich["r1"].tags == {"XS": "-", "CB": "AA", "UB": "CC"}
    assert rich["r2"].seq == "" and rich["r3"].unmapped
    bed = {r.name: r for r in alignments.sam_to_bed(alignments.read_sam_rich(spark, path)).collect()}
    assert set(bed) == {"r1", "r2"}
    assert [(e.start, e.end) for e in bed["r1"].exons] == [(6, 14), (17, 22)]


def test_sam_errors_name_the_line(spark, tmp_path):
    with pytest.raises(PySparkException, match="a.sam:2: unknown flag 99"):
        alignments.read_sam(spark, write(tmp_path / "a.sam", "@x\nr\t99\tc\t1\t0\t1M\t*\t0\t0\tA\t*\n")).collect()
    with pytest.raises(PySparkException, match="a.sam:1: a SAM record needs 11 columns"):
        alignments.read_sam(spark, write(tmp_path / "a.sam", "r\t0\tc\n")).collect()


def bgzf(data):
    out = b""
    for part in [data[i : i + 40] for i in range(0, len(data), 40)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam():
    ref = b"chr1\0"
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", len(ref)) + ref + struct.pack("<i", 1000)
    seq = bytes([0x12, 0x48, 0x12, 0x48, 0x12, 0x48, 0x12, 0x40])
    ops = struct.pack("<5I", 4 << 4 | 4, 6 << 4, 2 << 4 | 2, 3 << 4 | 3, 5 << 4)
    tags = b"CBZAA\0" + b"NMC\x03" + b"XSA+" + b"ZBBc" + struct.pack("<i", 2) + b"\x01\xff"
    raw = struct.pack("<iiBBHHHiiii", 0, 6, 3, 60, 0, 5, 0, 15, -1, -1, 0) + b"r1\0" + ops + seq + b"\xff" * 15 + tags
    return bgzf(head + struct.pack("<i", len(raw)) + raw)


def test_bam_equals_sam_and_truncation_fails(spark, tmp_path):
    path = tmp_path / "a.bam"
    path.write_bytes(bam())
    (row,) = bam_ranges.read_bam(spark, str(path)).collect()
    assert (row.qname, row.flag, row.rname, row.pos, row.cigar, row.seq) == ("r1", 0, "chr1", 7, "4S6M2D3N5M", "ACGTACGTACGTACG")
    assert (row.start, row.end, row.query_start, row.query_end) == (6, 22, 4, 15)
    assert row.tags == {"CB": "AA", "NM": "3", "XS": "+", "ZB": "c,1,-1"}
    for cut in (len(bam()) - 28, len(bam()) - 40):
        path.write_bytes(bam()[:cut])
        with pytest.raises(PySparkException):
            bam_ranges.read_bam(spark, str(path)).collect()


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "g.fa", ">a one two\n ac \nGT\n\n>b\nnn\n>a\ntt\n")
    assert {r.id: (r.description, r.seq) for r in annotations.read_fasta(spark, path).collect()} == {"a": ("", "TT"), "b": ("", "NN")}
    with pytest.raises(PySparkException, match="repeated sequence id a"):
        annotations.read_fasta(spark, path, unique=True).collect()
    with pytest.raises(PySparkException, match="sequence before a header"):
        annotations.read_fasta(spark, write(tmp_path / "h.fa", "ac\n>a\n")).collect()
    last = annotations.read_fasta_last_line(spark, write(tmp_path / "i.fa", ">x_PAR_Y\nAC\nGT\n>y_PAR_Y\n")).orderBy("record").collect()
    assert [(r.id, r.seq) for r in last] == [("x", "GT"), ("y_PAR_Y", "")]


def test_bed12_flavours(spark, tmp_path):
    row = "c\t10\t60\tG1;T1\t40\t+\t10\t60\t0\t2\t5,10,\t0,40,"
    (r,) = annotations.read_bed12(spark, write(tmp_path / "a.bed", row + "\n")).collect()
    assert [(e.start, e.end) for e in r.exons] == [(10, 15), (50, 60)]
    with pytest.raises(PySparkException, match="strand must be"):
        annotations.read_bed12(spark, write(tmp_path / "b.bed", row.replace("\t+\t", "\t.\t") + "\n")).collect()
    with pytest.raises(PySparkException, match="name must be"):
        annotations.read_bed12(spark, write(tmp_path / "b.bed", row.replace(";", "-") + "\n")).collect()
    loose = annotations.read_bed12(spark, write(tmp_path / "c.bed", "#x\n" + row.replace("5,10,", "5,x,10") + "\textra\n"), flavour="precise").collect()
    assert [(e.start, e.end) for e in loose[0].exons] == [(10, 15), (50, 60)]
    assert annotations.read_bed12(spark, write(tmp_path / "d.bed", "\n  \n" + row + "  \n"), flavour="combine").count() == 1


GTF = """c\tx\tgene\t11\t60\t.\t+\t.\tgene_id "g1"; gene_name "A";
c\tx\ttranscript\t11\t60\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; FPKM "2.5";
c\tx\texon\t51\t60\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c\tx\texon\t11\t15\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
c\tx\ttranscript\t71\t80\t.\t-\t.\tgene_id "g2"; transcript_id "t2"; FPKM "1";
c\tx\texon\t71\t80\t.\t-\t.\tgene_id "g2"; transcript_id "t2";
c\tx\tgene\t91\t95\t.\t-\t.\tgene_id "g3";
"""


def test_gtf_flavours(spark, tmp_path):
    path = write(tmp_path / "a.gtf", GTF)
    frags = {r.id: r for r in annotations.read_gtf_transfrags(spark, path, "S").collect()}
    assert [(e.start, e.end) for e in frags["S.1"].exons] == [(10, 15), (50, 60)] and frags["S.2"].expr == 1.0
    genes = {r.gene_id: r for r in annotations.read_gtf_annotation(spark, path).collect()}
    assert set(genes) == {"g1", "g2"} and (genes["g2"].start, genes["g2"].end, genes["g1"].label, genes["g2"].label) == (70, 80, "A", "g2")
    ends = {(r.kind, r.pos) for r in annotations.read_gtf_ends(spark, path).collect()}
    assert ends == {("tss", 10), ("tes", 60), ("tss", 70), ("tes", 80)}
    with pytest.raises(PySparkException, match="transcript without expression"):
        annotations.read_gtf_transfrags(spark, path, "S", expression="TPM").collect()


def test_tables(spark, tmp_path):
    manifest = annotations.read_merge_manifest(spark, write(tmp_path / "m", "a.bed\tcapped\t1,2,3\ts0\nb.bed\tno_cap\t1,1,1\ts1\n")).orderBy("ord").collect()
    assert [(r.path, r.capped, r.priority, r.name) for r in manifest] == [("a.bed", True, [1, 2, 3], "s0"), ("b.bed", False, [1, 1, 1], "s1")]
    with pytest.raises(PySparkException, match="bad manifest row"):
        annotations.read_merge_manifest(spark, write(tmp_path / "m", "a b.bed\tcapped\t1,2,3\ts0\n")).collect()
    combine = annotations.read_combine_manifest(spark, write(tmp_path / "c", "s1\tisoforms\ta.bed\ta.fa\tm\ns2\tisoforms\tb.bed\n")).orderBy("ord").collect()
    assert [(r.fasta, r.read_map) for r in combine] == [(None, "m"), (None, None)]
    samples = annotations.read_sample_manifest(spark, write(tmp_path / "s", "a\nb\tX\nc\n")).orderBy("ord").collect()
    assert [r.sample for r in samples] == ["1", "X", "2"]
    by_isoform, by_gene = annotations.read_read_map(spark, write(tmp_path / "r", "i1_g\ta,b\ni2_g\tc\ni1_g\td\n"))
    assert {r.isoform: r.n for r in by_isoform.collect()} == {"i1_g": 1, "i2_g": 1} and by_gene.first().n == 4
    counts = annotations.read_count_matrix(spark, write(tmp_path / "n.csv", 'cell,"f,1",f2\na,1,0\nb,0,2.5\n')).collect()
    assert {(r.cell, r.feature, r.n) for r in counts} == {("a", "f,1", 1.0), ("b", "f2", 2.5)}
    genes = annotations.read_gene_map(spark, write(tmp_path / "g.tsv", "x\ttranscripts\tgenes\n1\tt1\tg1\n")).collect()
    assert [(r.gene, r.feature) for r in genes] == [("g1", "t1")]
    long = annotations.read_long_counts(spark, write(tmp_path / "l.tsv", "#c\nfeature_id\tgroup_id\tcount\nf\tc1\t2\nf\tc2\t0\n")).collect()
    assert [(r.cell, r.feature, r.n) for r in long] == [("c1", "f", 2.0)]


def test_sink_lines(spark, tmp_path):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, "c", "+", "t1_chr1", [(10, 15), (50, 60)], 12, 55)], "ord int, chrom string, strand string, name string, exons array<struct<start:bigint,end:bigint>>, thick_start bigint, thick_end bigint")
    line = frame.select(sinks.bed12_line(F.col("exons"), chrom=F.col("chrom"), name=F.col("name"), score=F.lit(40), strand=F.col("strand"), rgb=F.lit("255,0,0")).alias("line")).first().line
    assert line == "c\t10\t60\tt1_chr1\t40\t+\t10\t60\t255,0,0\t2\t5,10\t0,40"
    rows = [r.line.split("\t") for r in sinks.gtf_rows(frame, source="S").orderBy("sub").collect()]
    assert [(r[2], r[3], r[4]) for r in rows] == [("transcript", "11", "60"), ("exon", "11", "15"), ("exon", "51", "60")] and rows[0][8] == 'gene_id "chr1"; transcript_id "t1";'
    coding = [r.line.split("\t") for r in sinks.gtf_rows(frame, source="S", coding=True).orderBy("sub").collect()]
    assert [(r[2], r[3], r[4]) for r in coding][3:] == [("CDS", "13", "15"), ("CDS", "51", "55"), ("start_codon", "13", "15"), ("5UTR", "11", "12"), ("3UTR", "56", "60")]
    numbers = spark.createDataFrame([(2.00001,), (2.5,), (0.1234567,)], "n double").select(sinks.count_text(F.col("n")).alias("t"), sinks.scientific(F.col("n")).alias("s")).collect()
    assert [r.t for r in numbers] == ["2", "2.5", "0.123457"] and numbers[1].s == "2.500000e0"
    sinks.single_file(frame.selectExpr("ord", "name AS line"), str(tmp_path / "o"), "ord", header="h")
    assert (tmp_path / "o").read_text() == "h\nt1_chr1\n"
