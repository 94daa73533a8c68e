import math

import numpy as np
import pytest

from strandloom.kernels import dirichlet, special
from strandloom.operators import usage


def test_special_functions():
    x = np.array([1e-4, 0.3, 1.0, 2.5, 9.9, 10.0, 400.0])
    assert np.allclose(special.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5
    assert np.allclose(special.digamma(x[1:]), (special.log_gamma(x[1:] + h) - special.log_gamma(x[1:] - h)) / (2 * h), rtol=1e-6)
    assert special.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, rel=1e-12)
    assert special.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, rel=1e-12)
    assert special.chi_square_tail(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert special.chi_square_tail(1.0, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-12)
    assert special.chi_square_tail(50.0, 4) == pytest.approx(math.exp(-25) * 26, rel=1e-10)
    assert special.chi_square_tail(0.0, 3) == 1.0


def sample(rng, shares, n, strength=8.0):
    p = rng.dirichlet(np.array(shares) * strength, size=n)
    return np.stack([rng.multinomial(rng.integers(5, 30), q) for q in p]).astype(float)


def test_fit_finds_the_maximum():
    rng = np.random.default_rng(1)
    counts = sample(rng, [0.6, 0.3, 0.1], 300)
    value, alpha = dirichlet.fit(counts)
    totals = counts.sum(axis=1)
    for _ in range(30):
        assert dirichlet._value(np.maximum(alpha * rng.uniform(0.8, 1.25, 3), 1e-4), counts, totals) >= value - 1e-9
    assert alpha / alpha.sum() == pytest.approx([0.6, 0.3, 0.1], abs=0.05)


def test_usage_test_tells_a_switch():
    rng = np.random.default_rng(2)
    a, b = sample(rng, [0.7, 0.2, 0.1], 60), sample(rng, [0.2, 0.7, 0.1], 60)
    rows = dirichlet.usage_test((["x", "y", "z"], ["x", "y", "z"]), (a, b), (60, 60), dirichlet.UsageSettings())
    assert rows[0]["p_DTU_gene"] < 1e-6 and rows[0]["isoform_switch"]
    assert rows[2]["p_transcript"] > 0.01
    same = dirichlet.usage_test((["x", "y"], ["x", "y"]), (a[:, :2], a[:, :2]), (60, 60), dirichlet.UsageSettings())
    assert same[0]["p_DTU_gene"] == pytest.approx(1.0, abs=1e-3) and not same[0]["isoform_switch"]
    assert dirichlet.usage_test((["x"], ["x"]), (a[:, :1], b[:, :1]), (10, 60), dirichlet.UsageSettings()) is None


def test_rare_isoforms_are_gathered():
    left = np.array([[98.0, 1.0, 1.0]] * 3)
    names, a, b = dirichlet.aligned((["p", "q", "r"], ["p", "s"]), (left, np.array([[50.0, 50.0]])), 0.05)
    assert names == ["p", "s", "other"]
    assert a[0].tolist() == [98.0, 0.0, 2.0] and b[0].tolist() == [50.0, 50.0, 0.0]


def test_differential_usage_frame(spark):
    rng = np.random.default_rng(3)
    frames = {}
    for side, shares in (("a", [0.7, 0.3]), ("b", [0.3, 0.7])):
        x, y = sample(rng, shares, 40), sample(rng, [0.5, 0.5], 40)
        iso = [(f"c{i}", f"{g}-{k}", float(v)) for g, m in (("g1", x), ("g2", y)) for i, row in enumerate(m) for k, v in enumerate(row) if v]
        gene = [(f"c{i}", g, float(row.sum())) for g, m in (("g1", x), ("g2", y)) for i, row in enumerate(m)]
        frames[side] = [spark.createDataFrame(r, "cell string, feature string, n double") for r in (gene, iso)]
    mapping = spark.createDataFrame([(g, f"{g}-{k}", k) for g in ("g1", "g2") for k in (0, 1)], "gene string, feature string, ord int")
    rows = usage.differential_usage(*frames["a"], mapping, *frames["b"], mapping).collect()
    by = {(r.gene, r.isoform): r for r in rows}
    assert len(rows) == 4
    assert by["g1", "g1-0"].p_DTU_gene_adj < 1e-4 < by["g2", "g2-0"].p_DTU_gene_adj
    assert by["g1", "g1-0"].isoform_switch and abs(by["g1", "g1-0"].TU1 - 0.7) < 0.1
    assert all(0 <= r.p_gene <= 1 and r.p_gene <= r.p_gene_adj for r in rows)
