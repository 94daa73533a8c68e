import numpy as np

from strandloom.kernels import exon_calls as e

S = e.RefineSettings()


def test_depth_and_stretches():
    blocks = np.array([(10, 60)] * 30 + [(70, 120)] * 30 + [(200, 215)] * 30 + [(300, 400)] * 5 + [(0, 999)])
    depth = e.depth_of(0, 500, blocks)
    assert depth[10] == 30 and depth[60] == 0 and depth[350] == 5
    assert e.deep_stretches(depth, 0, S) == [(10, 120)]
    assert e.deep_stretches(np.zeros(10), 0, S) == []


def test_splice_sites_cut_and_merge():
    junctions = [(50, 300)] * 40 + [(55, 300)] * 25 + [(90, 300)] * 3
    assert e.at_splice_sites([(0, 100), (290, 400)], junctions, S) == [(0, 50), (50, 100), (290, 400)]
    assert e.at_splice_sites([(0, 100)], [], S) == [(0, 100)]


def test_smoothing_mirrors():
    assert np.allclose(e.smoothed(np.full(20, 7.0)), 7.0)
    assert len(e.smoothed(np.arange(3.0))) == 3 and np.allclose(e.smoothed(np.array([4.0])), 4.0)


def test_steps_cut():
    depth = np.concatenate((np.full(100, 200), np.full(100, 40)))
    assert e.at_steps([(1000, 1200)], depth, 1000, e.RefineSettings(z_score=5)) in ([(1000, 1099), (1099, 1200)], [(1000, 1100), (1100, 1200)], [(1000, 1098), (1098, 1200)])
    assert e.at_steps([(1000, 1100)], depth[:100], 1000, S) == [(1000, 1100)]


def test_update_and_remap():
    known = [(0, 100), (200, 300)]
    assert e.updated_exons([(5, 100), (150, 180), (240, 310)], known) == [(0, 100), (150, 180), (200, 240), (240, 300)]
    assert e.updated_exons([(5, 50)], [(0, 100)]) == [(0, 100)]
    new = e.updated_exons([(240, 310)], known)
    assert e.remapped([[0], [0, 1]], known, new) == [[0, 1, 2], [0]]
