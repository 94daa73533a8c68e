import math

import numpy as np
import pytest

from strandloom.kernels import changepoints as cp


def test_ranks_and_rank_test():
    assert cp.average_ranks(np.array([5.0, 1.0, 5.0])).tolist() == [2.5, 1.0, 2.5]
    assert cp.approximate_erfc(0.7) == pytest.approx(math.erfc(0.7), abs=2e-7)
    assert cp.approximate_erfc(-0.7) == pytest.approx(math.erfc(-0.7), abs=2e-7)
    assert cp.rank_test(np.ones(5), np.ones(4)) == 1.0
    assert cp.rank_test(np.arange(20), np.arange(20) + 30) < 1e-6


def test_split_is_the_least_squares_one():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(5, 1, 30), rng.normal(9, 1, 25))).astype(np.float32)
    want = min(range(1, len(x)), key=lambda i: ((x[:i] - x[:i].mean()) ** 2).sum() + ((x[i:] - x[i:].mean()) ** 2).sum())
    assert cp.best_split(x) == want
    assert cp.best_split(x[:1]) == -1


def test_smoothing_adds_one_and_keeps_constants():
    assert cp.smooth(np.full(100, 3.0), 21) == pytest.approx(np.full(101, 3.0))
    slope = np.array([1.0, 1.0, -1.0, -2.0, 0.0, 1.0])
    assert cp.same_sign_run(slope, 2) == (1, 2, -1)
    assert cp.same_sign_run(slope, 1) == (2, 1, 1)
    assert cp.same_sign_run(slope, 4) == (0, 0, 0)


def test_a_step_is_found_and_noise_is_not():
    rng = np.random.default_rng(2)
    step = np.concatenate((rng.normal(100, 2, 200), rng.normal(30, 2, 200))).astype(np.float32)
    found = cp.change_points(step, window=20)
    assert found and abs(found[0].pos - 200) <= 3 and found[0].sign == -1 and found[0].start < found[0].pos < found[0].end
    assert cp.change_points(rng.normal(100, 2, 400), window=20) == []
    assert cp.change_points(step[:10], window=20) == []


def test_zero_crossings():
    assert cp.zero_crossings(np.array([0, 0, 2, 2, 0, 1]), 100) == [102, 104, 105]
