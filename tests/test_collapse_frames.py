import random

from strandloom.operators import collapse
from strandloom.sources import alignments, annotations


def test_collapse_from_sam_and_fasta(spark, tmp_path):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(1200))
    (tmp_path / "g.fa").write_text(f">c x\n{genome[:700]}\n{genome[700:]}\n")
    rows = []

    def add(name, flag, pos, cigar, seq):
        rows.append("\t".join([name, str(flag), "c", str(pos), "60", cigar, "*", "0", "0", seq, "*"]))

    spliced = genome[100:200] + genome[300:400]
    for k in range(6):
        add(f"r{k}", 0, 101, "100M100N100M", spliced)
    changed = spliced[:150] + ("A" if spliced[150] != "A" else "C") + spliced[151:]
    for k in range(5):
        add(f"v{k}", 0, 101, "100M100N100M", changed)
    add("clipped", 0, 101, "50S100M", "A" * 50 + genome[100:200])
    add("minus", 16, 901, "200M", genome[900:1100])
    add("minus", 16, 903, "190M", genome[902:1092])
    add("lost", 4, 0, "*", "ACGT")
    (tmp_path / "a.sam").write_text("\n".join(rows) + "\n")
    reads, fasta = alignments.read_sam(spark, str(tmp_path / "a.sam")), annotations.read_fasta(spark, str(tmp_path / "g.fa"))
    models = {r.model_id: r for r in collapse.collapse(reads, fasta).collect()}
    assert set(models) == {"G1.1", "G2.1"}
    first = models["G1.1"]
    assert (first.starts, first.ends, len(first.reads), first.strand) == ([101, 301], [201, 401], 11, "+")
    assert (models["G2.1"].starts, models["G2.1"].ends, models["G2.1"].strand) == ([901], [1101], "-")
    walked = collapse.walked_reads(reads, fasta).cache()
    (variant,) = collapse.supported_variants(walked, collapse.accepted_reads(walked)).collect()
    assert (variant.pos, variant.kind, variant.support, variant.cover) == (350, "M", 5, 11)


def test_windows_beyond_the_three_prime_end_equal_the_kernel(spark):
    from strandloom.kernels.alignment_errors import polya_window

    rng = random.Random(8)
    genome = "".join(rng.choice("ACGTN") for _ in range(300))
    rows = [(k, "c", rng.choice("+-"), a, a + 30) for k, a in enumerate([0, 3, 15, 100, 250, 268, 270, 290, 400])]
    models = spark.createDataFrame(rows, "model long, scaffold string, strand string, start long, end long")
    fasta = spark.createDataFrame([("c", genome)], "id string, seq string")
    found = {r.model: (r.polya_seq, r.a_count, r.a_share) for r in collapse.polya_windows(models, fasta, ["model"]).collect()}
    assert found == {k: polya_window(s, genome, a, b) for k, _, s, a, b in rows}
