import random
from pathlib import Path

import numpy as np
import pytest

from strandloom.llm import embeddings, minhash
from strandloom.llm.components import connected_components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def closed(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 40, 150]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 5])):
            other = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    return [*texts, None, "", "  \n", texts[0], texts[0].upper()]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(docs, corpus, width):
    sets = [shingles(t, width) for t in corpus]
    linked = [[i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = closed(len(corpus), linked)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs(list(enumerate(corpus))), width=width).collect()}
    assert len(found) == len(corpus)
    for i, s in enumerate(sets):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(s), want[i], want[i] == i)


def test_a_chain_whose_ends_differ_is_one_component(docs):
    base = [f"a{i}" for i in range(100)]
    chain = [" ".join([*(f"b{j}" for j in range(4 * k)), *base[4 * k :]]) for k in range(12)]
    found = minhash.near_duplicates(docs(list(enumerate(chain)))).collect()
    assert {r.component_id for r in found} == {0}


def test_many_near_copies_in_one_group(docs, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = random.Random(4)
    base = [f"a{i}" for i in range(60)]
    texts = []
    for _ in range(80):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2])):
            t[rng.randrange(60)] = f"c{rng.randrange(30)}"
        texts.append(" ".join(t))
    sets = [shingles(t, 4) for t in texts]
    want = closed(len(texts), [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets])
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_rows_without_id_repeated_ids_and_empty_tables(docs):
    text = "one two three four five six"
    rows = minhash.near_duplicates(docs([(None, text), (3, text), (3, text), (4, text), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("3", "3", True), ("3", "3", True), ("4", "3", False), ("None", "None", True), ("None", "None", True)]
    assert minhash.near_duplicates(docs([])).count() == 0


def test_representatives_keep_all_columns(docs):
    frame = docs([(1, "one two three four five six"), (2, "one two three four five six"), (3, None)])
    kept = minhash.keep_representatives(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_signatures_estimate_similarity_and_do_not_hang_on_order():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, size=400).astype(np.uint64)
    for n, common in ((300, 240), (4, 2), (1, 1), (60, 48)):
        a, b = pool[:n], np.concatenate((pool[:common], pool[350 : 350 + min(50, n - common)]))
        sets = [np.sort(a), a[::-1].copy(), b]
        signature = minhash.super_minhash(np.concatenate(sets), np.repeat(np.arange(3), [len(s) for s in sets]), 3, 120)
        assert (signature[0] == signature[1]).all()
        assert not (signature == 0xFFFFFFFFFFFFFFFF).any()
        true = common / (n + len(b) - common)
        assert abs((signature[0] == signature[2]).mean() - true) < 0.2


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(100, 100 + k) for k in range(1, 9)] + [(210, 205), (205, 207), (207, 210), (300, 300)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 21))
    assert all(found[100 + k] == 100 for k in range(9))
    assert {found[i] for i in (205, 207, 210)} == {205}
    assert 300 not in found


def vectors(seed=0, groups=12, size=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=size)
        for k in range(rng.integers(1, 9)):
            v = centre + rng.normal(size=size) * rng.choice([0.0, 0.03, 0.1, 0.2])
            rows.append((v.astype(np.float32).tolist(), int(g % 3)))
    return rows


def check_vectors(spark, rows):
    data = [(i, v, label) for i, (v, label) in enumerate(rows)]
    found = {r.vec_id: r for r in embeddings.embedding_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}

    def unit(v):
        good = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        return np.asarray(v, dtype=np.float32).astype(float) / np.linalg.norm(np.asarray(v, dtype=np.float32).astype(float)) if good else None

    units = [unit(v) for v, _ in rows]
    n = len(rows)
    linked = [[i != j and units[i] is not None and units[j] is not None and rows[i][1] is not None and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98 for j in range(n)] for i in range(n)]
    want = closed(n, linked)
    for i in range(n):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (sum(linked[i]), want[i], want[i] == i)
    return sum(map(sum, linked))


def test_embedding_links_equal_brute_force(spark):
    assert check_vectors(spark, vectors()) > 20


def test_embedding_odd_vectors(spark):
    rows = [*vectors(1, 3), (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0, None] * 8, 1), ([1.0] * 16, None), ([1.0] * 4, 1), ([1.0] * 4, 1), ([2.0] * 4, 1), ([], 1), ([3.0], 2), ([4.0], 2)]
    check_vectors(spark, rows)


def test_embedding_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 4)
    assert check_vectors(spark, vectors(7, 4)) > 5


def test_embedding_shards_and_blocks(spark, monkeypatch):
    for name, size in {"SHARD": 7, "BLOCK": 3, "TILE": 3}.items():
        monkeypatch.setattr(embeddings, name, size)
    assert check_vectors(spark, vectors(5, 20)) > 20


def test_embedding_search_writes_less_than_its_input(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    data = [(i, v, 1) for i, v in enumerate(rng.normal(size=(3000, 64)).tolist())]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/input")
    size = lambda frame: sum(Path(f.removeprefix("file://")).stat().st_size for f in frame.inputFiles())
    written, write = [], embeddings.staged
    monkeypatch.setattr(embeddings, "staged", lambda *a: written.append(write(*a)) or written[-1])
    rows = spark.read.parquet(f"file://{tmp_path}/input")
    assert embeddings.embedding_duplicates(rows).where("kept AND n_links = 0").count() == 3000
    assert sum(map(size, written)) < size(rows)


def test_near_codes_make_groups():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 40))
    x = np.repeat(x, 3, axis=0) + rng.normal(size=(1200, 40)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coder = embeddings.Coder.fit(x, 4)
    codes = embeddings._codes(x, coder.axes)
    most = coder.reach(0.98)
    wide = codes.astype(int)
    linked = ((wide[:, None] - wide[None]) ** 2).sum(axis=2) <= most
    assert (linked >= (x @ x.T >= 0.98)).all()
    np.fill_diagonal(linked, False)
    want = np.where(linked.any(axis=1), closed(1200, linked.tolist()), -1)
    assert coder.near(codes, codes, most, same=True).tolist() == want.tolist()
    across = coder.near(codes[::2], codes[1::2], most, same=False)
    assert ((across >= 0) == np.concatenate((linked[::2, 1::2].any(axis=1), linked[::2, 1::2].any(axis=0)))).all()


def test_index_visits_cells_in_order_and_misses_no_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.03
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    index = embeddings.MultiIndex.fit(x, 12)
    first, second = index.bounds(x)
    home = index.home(y)
    missed = found = 0
    for k in range(len(x)):
        cells = index.visit(first[k], second[k], 0.04 + 1e-9)
        bounds = [first[k][c // 12] + second[k][c % 12] for c in cells]
        assert bounds == sorted(bounds)
        if x[k] @ y[k] >= 0.98:
            found += 1
            missed += home[k] not in cells
    assert found > 300 and missed == 0


def test_representatives_are_removed_by_row(docs):
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = minhash.keep_representatives(docs([(3, text), (7, text), (7, other), (None, text), (9, None)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows if r.text) == [("3", text), ("7", other), ("None", text)]
    assert len(rows) == 4


@pytest.mark.parametrize("tile", [4, 16, 512])
def test_a_large_group_with_members_apart(docs, monkeypatch, tile):
    """Members apart from all others, members near another stray only, and sizes at the edge of reach."""
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = random.Random(11)
    base = [f"a{i}" for i in range(70)]
    texts = []
    for k in range(90):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            t[rng.randrange(70)] = f"c{rng.randrange(8)}"
        texts.append(" ".join(t[: rng.choice([70, 70, 62, 55])]))
    sets = [shingles(t, 4) for t in texts]
    want = closed(len(texts), [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets])
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == want
