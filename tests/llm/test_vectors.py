import hashlib
import math

import numpy as np
import pytest

from strandloom.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, n int, _vec string, w int"


@pytest.fixture
def vectors(spark):
    """A frame of (vec_id, embedding) rows, with further columns whose names clash."""
    return lambda rows: spark.createDataFrame([(i, v, 0, "c", 1, "v", 2) for i, v in rows], SCHEMA)


def near_lattice(n, dims, seed, levels=5):
    """Rows of few levels, so that distances tie often."""
    rng = np.random.default_rng(seed)
    return (rng.integers(-levels, levels, (n, dims)) / 64).tolist()


def clusters(rows, k, rounds, dims):
    """Lloyd's rounds by definition, over Python's integers."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: "" if i is None else str(i)
    book = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{name(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    best = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        own = [best(x)[1] for _, x in kept]
        for j in range(len(book)):
            members = [x for o, (_, x) in zip(own, kept, strict=True) if o == j]
            if members:
                book[j] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *best(x)[::-1]) for i, x in kept]
    share = [sum(d for _, c, d in found if c == j) for j in range(len(book))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted((name(i), c, d, share[c], sum(share), digest[c]) for i, c, d in found)


def run_clusters(frame, **options):
    rows = centroids.cluster_vectors(frame, **options).collect()
    return sorted(("" if r.vec_id is None else str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows)


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters_equal_lloyds_rounds(vectors, k):
    rows = list(enumerate(near_lattice(150, 6, k)))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (500, None), (501, []), (502, [0.1] * 5), (503, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6), (505, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0])]
    assert run_clusters(vectors(rows), k=k, dims=6) == clusters(rows, k, 5, 6)


@pytest.mark.parametrize("size", [1e4, 1e5, 3e6])
def test_large_entries_stay_exact(vectors, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(4) * (size if i % 5 == 0 else 1)).tolist()) for i in range(60)]
    assert run_clusters(vectors(rows), k=6, dims=4) == clusters(rows, 6, 5, 4)


def test_distances_beyond_a_long_are_null_and_integers_beyond_are_left_out(vectors):
    found = run_clusters(vectors([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [1e300, 0.0])]), k=1, rounds=0, dims=2)
    assert [r[0] for r in found] == ["1", "2"] and {r[2] for r in found} == {0, None} and {r[4] for r in found} == {None}


def test_clusters_of_few_or_no_vectors(vectors):
    assert run_clusters(vectors([])) == []
    rows = [(1, [0.5, 0.5]), (2, [0.25, 0.5])]
    assert run_clusters(vectors(rows), dims=2) == clusters(rows, 40, 5, 2)


def test_the_annulus_holds_every_nearest_centroid():
    rng = np.random.default_rng(8)
    book = rng.integers(-30, 30, (40, 8)) * np.arange(1, 41)[:, None]
    book[7] = book[21]
    x = np.vstack((book[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 8)), book))
    first, last = centroids.Annulus(book).bounds(x)
    assert (last - first).mean() < 30  # the search leaves centroids out
    number, distance = centroids.Annulus(book).nearest(x)
    want = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (number == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def whitened(rows, components=8):
    """(ids, n, deviations, projections, shares) by numpy, from integers."""
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    gaps = [[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in kept]
    centred = np.array(gaps, dtype=float) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return [i for i, _ in kept], n, [sum(g * g for g in row) for row in gaps], centred @ axes / np.sqrt(values), values / np.trace(cov)


def test_whitening_equals_an_eigendecomposition(vectors):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 12)) @ np.diag(np.linspace(3, 0.3, 12)) + 40
    rows = [(i % 280, v) for i, v in enumerate(data.tolist())]
    dropped = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [])]
    found = whitening.whiten(vectors([*rows, *dropped])).collect()
    ids, n, deviations, w, share = whitened(rows)
    assert len(found) == 300 * 8 and {r.n for r in found} == {n} and found[0].identity_error < 1e-9
    assert sorted((r.vec_id, r.deviation) for r in found if r.component == 1) == sorted(zip(ids, deviations, strict=True))
    for c in range(8):
        own = sorted((r.vec_id, r.deviation, r.whitened) for r in found if r.component == c + 1)
        want = [v for *_, v in sorted(zip(ids, deviations, w[:, c].tolist(), strict=True))]
        sign = np.sign(own[0][2] * want[0])
        assert np.allclose([r[2] * sign for r in own], want, atol=1e-9)
        assert all(r.explained == pytest.approx(share[c], rel=1e-9) for r in found if r.component == c + 1)


def test_whitening_of_degenerate_tables(vectors):
    assert whitening.whiten(vectors([])).count() == 0
    assert whitening.whiten(vectors([(1, [0.5, 1.0])])).count() == 0
    assert whitening.whiten(vectors([(1, [0.5, 1.0])] * 3)).count() == 0
    line = whitening.whiten(vectors([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-9


def test_the_commonest_length_is_whitened(vectors):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(9)] + [(20 + i, rng.standard_normal(2).tolist()) for i in range(4)]
    found = whitening.whiten(vectors(rows)).collect()
    assert {r.vec_id for r in found} == set(range(9)) and {r.component for r in found} == {1, 2, 3}


@pytest.mark.parametrize("size", [1e7, 1e11, 1e14])
def test_deviations_stay_exact_beyond_a_long(vectors, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(3) * size).tolist()) for i in range(8)]
    found = {r.vec_id: r for r in whitening.whiten(vectors(rows)).where("component = 1").collect()}
    for i, deviation in zip(*whitened(rows)[::2][:2], strict=True):
        exact = deviation if deviation < 10**38 else None
        assert (found[i].deviation_exact is None) == (exact is None)
        assert exact is None or int(found[i].deviation_exact) == exact
        assert found[i].deviation == (deviation if deviation < 1 << 63 else None)
