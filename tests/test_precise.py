from collections import Counter

import numpy as np

from strandloom.kernels import peaks
from strandloom.kernels.peaks import PeakSettings
from strandloom.operators import precise


def test_peaks_weigh_near_reads():
    positions, counts = np.array([100, 150, 160, 400]), np.array([3.0, 2.0, 2.0, 3.0])
    assert positions[peaks.best_peak(positions, counts, 100, first=True)] == 150
    tie = np.array([0, 1000]), np.array([2.0, 2.0])
    assert peaks.best_peak(*tie, 100, first=True) == 0 and peaks.best_peak(*tie, 100, first=False) == 1


def test_snapping_keeps_to_its_side():
    assert peaks.snapped(100, {95, 105, 130}, 10) == 95
    assert peaks.snapped(100, {95, 105}, 10, above=100) == 105
    assert peaks.snapped(100, {110}, 10) == 100


def test_further_peaks_need_support():
    ends = Counter({(100, 900): 10, (500, 900): 6, (700, 900): 1})
    rows = peaks.chain_ends(ends, PeakSettings(), junctions=(800, 850))
    assert [r[:2] for r in rows] == [(100, 900), (500, 900)]
    assert len(peaks.chain_ends(ends, PeakSettings(rule="longest"), junctions=(800, 850))) == 1
    assert peaks.chain_ends(ends, PeakSettings(rule="longest", per_isoform=True), junctions=(800, 850))[0][:2] == (100, 900)
    assert peaks.renamed("r_g", 1) == "r-1_g" and peaks.renamed("r", 2) == "r-2"


def test_read_groups():
    reads = [(0, 1000, 5, "a", "+"), (10, 1010, 5, "b", "+"), (900, 2000, 1, "c", "-"), (5000, 5100, 1, "d", "-")]
    groups = peaks.group_reads(reads, 100)
    assert [g.name for g in groups] == ["a", "c", "d"]
    assert groups[0].low == 5 and groups[0].strands == {"+": 2}


def test_precise_frames(spark):
    rows = [(i, "c", 100 + (i % 3), 900 + (i % 2), f"r{i}_g", "+", [(100 + (i % 3), 300), (600, 900 + (i % 2))]) for i in range(12)]
    rows += [(20 + i, "c", 5000 + i, 6000, f"u{i}", "-", [(5000 + i, 6000)]) for i in range(5)] + [(40, "chrM", 1, 90, "m", "+", [(1, 20), (40, 90)])]
    bed = spark.createDataFrame(rows, "ord long, chrom string, start long, end long, name string, strand string, exons array<struct<start:bigint,end:bigint>>")
    (spliced,) = precise.spliced_isoforms(bed).collect()
    assert (spliced.name, spliced.start, spliced.end, spliced.strand) == ("r0_g", 100 + 1, 900 + 1, "+") or (spliced.start, spliced.end) in {(100, 900), (101, 901), (101, 900)}
    ends = spark.createDataFrame([("c", "tss", 80), ("c", "tes", 950), ("d", "tss", 100)], "chrom string, kind string, pos long")
    (known,) = precise.spliced_isoforms(bed, ends=ends).collect()
    assert (known.start, known.end, [tuple(e) for e in known.exons]) == (80, 950, [(80, 300), (600, 950)])
    (single,) = precise.unspliced_isoforms(bed).collect()
    assert (single.chrom, single.end, single.name, single.strands) == ("c", 6000, "u0", 5)
