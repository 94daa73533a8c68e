import itertools
import random
from collections import Counter

import numpy as np
import pytest

from strandloom.kernels import isoforms as iso
from strandloom.kernels.changepoints import ChangePoint
from strandloom.kernels.path_graph import SINK, SOURCE, PathGraph
from strandloom.kernels.splice_graph import Coverage, Frag, Guide, SpliceGraph, Walk
from strandloom.kernels.suffixes import SuffixIndex


def made(rng, n=6, span=60):
    """Random exon lists with positive gaps."""
    frags = []
    for _ in range(n):
        edges = sorted(rng.sample(range(span), 2 * rng.choice([1, 2, 3])))
        exons = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        frags.append(Frag(exons, float(rng.randrange(1, 9))))
    return frags


def bases(frags, low, high):
    depth = np.zeros(high - low, dtype=np.float32)
    for f in frags:
        for a, b in f.exons:
            depth[a - low : b - low] += np.float32(f.expr)
    return depth


@pytest.mark.parametrize("seed", range(10))
def test_coverage_equals_base_by_base(seed):
    frags = made(random.Random(seed))
    low, high = min(f.exons[0][0] for f in frags), max(f.exons[-1][1] for f in frags)
    depth, cover = bases(frags, low, high), Coverage(low, high, frags)
    assert cover.bases(low, high).tolist() == depth.tolist()
    assert cover.bases(low + 1, high - 1).tolist() == depth[1:-1].tolist()
    assert cover.crossings() == [low + i for i in range(1, len(depth)) if (depth[i] > 0) != (depth[i - 1] > 0)]
    runs = [(low, value, len(list(g))) for value, g in itertools.groupby(depth.tolist())]
    at, want = low, []
    for _, value, n in runs:
        if value:
            want.append((at, at + n, value))
        at += n
    assert list(zip(*(x.tolist() for x in cover.runs()), strict=True)) == want


@pytest.mark.parametrize("strand", "+-.")
@pytest.mark.parametrize("seed", range(12))
def test_nodes_equal_brute_force_over_positions(strand, seed):
    rng = random.Random(seed)
    frags = made(rng)
    sites = frozenset(rng.sample(range(10, 50), 2)) if seed % 2 else frozenset()
    g = SpliceGraph(strand, frags, start_sites=sites)
    low, high = g.low, g.high
    depth = bases(frags, low, high)
    bounds = {low, high, *sites} | {p for f in frags for gap in f.introns for p in gap} | {low + i for i in range(1, len(depth)) if (depth[i] > 0) != (depth[i - 1] > 0)}
    assert g.bounds.tolist() == sorted(bounds)
    spans = list(zip(sorted(bounds), sorted(bounds)[1:], strict=False))
    node_of = {p: k for k, (a, b) in enumerate(spans) for p in range(a, b)}
    steps = set()
    for w in g.walks:
        want = list(dict.fromkeys(node_of[p] for a, b in w.frag.exons for p in range(a, b)))
        assert w.nodes == (want[::-1] if strand == "-" else want)
        steps |= set(zip(w.nodes, w.nodes[1:], strict=False))
    used = {n for w in g.walks for n in w.nodes}
    here = {k for k, (a, b) in enumerate(spans) if (b if strand == "-" else a) in sites and k in used}
    assert g.starts == (used - {b for _, b in steps}) | here
    assert g.stops == used - {a for a, _ in steps}
    for w in g.walks:  # a walk gives its exons back, widened to whole nodes at the ends
        back = g.exons(w.nodes)
        inner = [p for a, b in back for p in (a, b)][1:-1]
        assert back[0][0] <= w.frag.exons[0][0] and back[-1][1] >= w.frag.exons[-1][1]
        assert {p for a, b in w.frag.introns for p in (a, b)} >= set(inner)
        assert set(range(*back[0])) <= {p for n in w.nodes for p in range(*g.span(n))}


def test_exons_come_back_where_frags_share_their_ends():
    exons = [(0, 10), (20, 30), (40, 60)]
    for strand in "+-":
        g = SpliceGraph(strand, [Frag(exons, 2.0), Frag([(0, 10), (40, 60)], 1.0)])
        assert [g.exons(w.nodes) for w in g.walks] == [exons, [(0, 10), (40, 60)]]
        assert all(w.from_source and w.to_sink for w in g.walks)


@pytest.mark.parametrize("seed", range(8))
def test_parts_are_the_components_by_first_frag(seed):
    frags = made(random.Random(seed), n=5, span=200)
    g = SpliceGraph("+", frags)
    groups = []
    for w in g.walks:
        near = [x for x in groups if any(set(w.nodes) & set(o.nodes) for o in x)]
        merged = [o for x in near for o in x] + [w]
        groups = [x for x in groups if x not in near] + [merged]
    order = {id(w): k for k, w in enumerate(g.walks)}
    want = sorted((sorted(order[id(w)] for w in x) for x in groups), key=min)
    parts = g.parts()
    assert [[frags.index(f) for f in p.own] for p in parts] == want


def test_a_trim_moves_ends_on_the_slope_and_adds_sites():
    frags = [Frag([(0, 100), (200, 300)], 5.0), Frag([(0, 100), (200, 280)], 1.0), Frag([(0, 100), (200, 240)], 1.0)]
    fall = ChangePoint(260, 250, 290, 0.001, 0.2, -1)
    plus = SpliceGraph("+", frags).changed([fall], trim=True)
    assert [f.exons[-1] for f in plus.own] == [(200, 300), (200, 260), (200, 240)]  # 300 lies beyond the slope
    assert plus.stop_sites == {260} and not plus.start_sites and frags[1].exons[-1] == (200, 280)
    minus = SpliceGraph("-", frags).changed([fall], trim=False)
    assert minus.start_sites == {260} and [f.exons for f in minus.own] == [f.exons for f in frags]
    rise = ChangePoint(30, 0, 50, 0.001, 0.2, 1)
    assert [f.exons[0] for f in SpliceGraph("+", frags).changed([rise], trim=True).own] == [(30, 100)] * 3
    # an outer exon that begins on the slope stays
    short = [Frag([(0, 100), (255, 280)], 1.0), Frag([(0, 100), (200, 300)], 1.0)]
    assert SpliceGraph("+", short).changed([ChangePoint(250, 240, 290, 0.001, 0.2, -1)], trim=True).own[0].exons[-1] == (255, 280)


def test_a_drop_in_coverage_becomes_a_stop():
    rng = random.Random(1)
    frags = [Frag([(0, 400)], 100.0)] + [Frag([(0, 200 + rng.randrange(-8, 9))], 100.0) for _ in range(40)]
    found = SpliceGraph("+", frags).changes(0.01, 0.85)
    assert found and all(abs(c.pos - 200) < 20 and c.sign < 0 for c in found)
    g = SpliceGraph("+", frags).changed(found, trim=True)
    assert found[0].pos in g.bounds and g.stop_sites == {c.pos for c in found}


def test_guides():
    frags = [Frag([(0, 50), (80, 120)], 1.0), Frag([(10, 50), (80, 100)], 0.0, known=True), Frag([(10, 40), (80, 100)], 0.0, known=True)]
    plain, ends, paths = (SpliceGraph("-", frags, g) for g in (Guide(), Guide(ends=True), Guide(assembly=True)))
    assert plain.bounds.tolist() == [0, 50, 80, 120] and len(plain.walks) == 1
    assert ends.bounds.tolist() == [0, 10, 50, 80, 100, 120] and ends.known_starts == [100] and ends.known_stops == [10]
    assert {ends.span(n) for n in ends.starts} == {(100, 120), (80, 100)} and {ends.span(n) for n in ends.stops} == {(0, 10), (10, 50)}
    assert paths.bounds.tolist() == [0, 40, 50, 80, 120] and len(paths.walks) == 3
    assert paths.node_rows()[0] == {"start": 80, "end": 120, "least": 1.0, "most": 1.0, "mean": 1.0, "known_starts": [100], "known_stops": []}


@pytest.mark.parametrize("seed", range(20))
def test_suffix_index_equals_a_scan(seed):
    rng = random.Random(seed)
    texts = [tuple(rng.randrange(3) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 9))]
    index = SuffixIndex(texts)
    for size in range(1, 5):
        for pattern in itertools.product(range(4), repeat=size):
            want = Counter(k for k, t in enumerate(texts) for i in range(len(t) - size + 1) if t[i : i + size] == pattern)
            assert Counter(index.find(pattern)) == want
    assert index.find(()) == [] and SuffixIndex([]).find((1,)) == []


def walk(nodes, expr, source=True, sink=True):
    return Walk(list(nodes), Frag([(0, 1)], expr), source, sink)


@pytest.mark.parametrize("seed", range(15))
def test_rescue_equals_a_scan_of_all_kmers(seed):
    rng = random.Random(seed)
    walks = [walk(sorted(rng.sample(range(8), rng.randrange(2, 8))), float(rng.randrange(1, 9)), rng.random() < 0.7, rng.random() < 0.7) for _ in range(12)]
    for k in (2, 3, 4):
        g = iso.k_graph(walks, k)
        names, before = {n: g.graph.names[n] for n in g.graph.numbers()}, list(g.graph.weight)
        want, lost, lost_expr = dict(enumerate(before)), 0, 0.0
        for w in g.short:
            m = len(w.nodes)
            hits = [n for n, name in names.items() for i in range(len(name) - m + 1) if list(name[i : i + m]) == w.nodes]
            total = sum(before[n] for n in hits)
            if not hits:
                lost, lost_expr = lost + 1, lost_expr + w.frag.expr
            for n in hits:
                want[n] += w.frag.expr * before[n] / total
        assert iso.rescue(g) == (lost, pytest.approx(lost_expr))
        assert g.graph.weight == pytest.approx([want[n] for n in range(len(want))])


def test_a_walk_found_twice_in_a_kmer_takes_two_shares():
    g = iso.KGraph(4, PathGraph(), [walk((2, 3), 6.0, sink=False)], 0, 0.0)
    g.graph.add([(2, 3, 2, 3)], 1.0)
    g.graph.add([(3, 2, 3, 4)], 1.0)
    assert iso.rescue(g) == (0, 0.0)
    assert [g.graph.weight[n] for n in g.graph.numbers()] == pytest.approx([5.0, 3.0])


def test_bisection():
    assert iso.best_of_range(10, lambda k: -((k - 3) ** 2)) == 3
    assert iso.best_of_range(4, lambda k: 5 if k <= 2 else 1) == 1
    assert iso.best_of_range(1, lambda k: 0) == 1
    for most in range(1, 60):
        for peak in range(1, most + 1):
            asked = []
            assert iso.best_of_range(most, lambda k: asked.append(k) or -abs(k - peak)) == peak  # noqa: B023
            assert len(asked) == len(set(asked)) <= 20
    assert iso.best_of_range(40, lambda k: 7) == 1


def test_choice_of_k_and_its_rows():
    walks = [walk((0, 1, 2), 1e6)]
    best, rows = iso.choose_k(walks)
    assert best.k == 1 and [(r["k"], r["kmers"], r["score"], r["valid"], r["chosen"]) for r in rows] == [(1, 3, 3, True, False), (2, 2, 2, True, False), (3, 1, 1, True, False), (1, 3, 3, True, True)]
    # with k = 1 the way from 0 to 4 exists by two halves; longer k-mers break it
    halves = [walk((0, 1, 2), 1.0, sink=False), walk((2, 3, 4), 1.0, source=False)]
    best, rows = iso.choose_k(halves)
    assert best.k == 1 and [r["valid"] for r in rows if not r["chosen"]] == [True, False, False]
    assert [r["lost_kmers"] for r in rows if r["k"] == 3] == [4]
    assert iso.choose_k(halves, 1)[1][-1]["k_most"] == 1
    short = [walk((0, 1, 2), 4.0), walk((1,), 1.0, source=False, sink=False)]
    row = iso.k_graph(short, 2)
    assert len(row.short) == 1 and row.weight == 4.0


@pytest.mark.parametrize("seed", range(30))
def test_validity_equals_a_search_from_the_source(seed):
    rng = random.Random(seed)
    graph = PathGraph()
    for _ in range(rng.randrange(1, 6)):
        graph.add(sorted(rng.sample(range(7), rng.randrange(1, 4))), 1.0, from_source=rng.random() < 0.4, to_sink=rng.random() < 0.4)
    assert graph.connected() == (SINK in PathGraph._reach(SOURCE, graph.after))


def test_order_takes_the_latest_node_first():
    graph = PathGraph()
    graph.add("ab", 1.0)
    graph.add("c", 1.0)
    graph.add("cb", 1.0)
    assert [graph.names[n] for n in graph.order()] == ["source", "a", "c", "b", "sink"]


def brute_widest(weights, paths, share):
    """All paths by falling flow, each subtracted: by listing every path."""
    flow, found, least = dict(weights), [], None
    while True:
        width, path = max(((min(flow[n] for n in p), p) for p in paths), key=lambda x: x[0])
        if least is not None and width <= least:
            return found
        least = max(width * share, 1e-10) if least is None else least
        found.append((sorted(path), width))
        for n in path:
            flow[n] = max(flow[n] - width, 1e-10)


@pytest.mark.parametrize("seed", range(12))
def test_all_widest_paths_equal_brute_force_with_subtraction(seed):
    rng = random.Random(seed)
    graph = PathGraph()
    for k in range(6):
        graph.add(sorted(rng.sample(range(9), rng.randrange(1, 6))), float(2**k + rng.randrange(2)))

    def every(node):
        return [[SINK]] if node == SINK else [[node, *rest] for m in graph.after[node] for rest in every(m)]

    found = graph.widest_paths(0.05)
    want = brute_widest(dict(enumerate(graph.weight)), every(SOURCE), 0.05)
    assert [w for _, w in found] == pytest.approx([w for _, w in want], rel=1e-5)


def test_clusters():
    kept = iso.cluster_paths([([1], 10.0), ([1], 0.1), ([2], 0.1), ([1], 0.5)], 0.05)
    assert [w for c in kept for _, w in c.paths] == [10.0, 0.5, 0.1]
    joined = iso.cluster_paths([([1, 2], 9.0), ([3], 5.0), ([5], 4.0), ([3, 2], 3.0), ([5], 0.2)], 0.05)
    assert [[w for _, w in c.paths] for c in joined] == [[9.0, 5.0, 3.0], [4.0]]
    assert joined[0].flow == pytest.approx(17.0)
    assert iso.cluster_paths([], 0.05) == []


@pytest.mark.parametrize("seed", range(10))
def test_clusters_are_components_where_nothing_is_dropped(seed):
    rng = random.Random(seed)
    paths = [(rng.sample(range(14), 2), 100.0 - k) for k in range(9)]
    groups = []
    for nodes, flow in paths:
        near = [g for g in groups if g[0] & set(nodes)]
        groups = [g for g in groups if g not in near] + [(set(nodes).union(*(g[0] for g in near)), sorted([flow, *(w for g in near for w in g[1])], reverse=True))]
    assert sorted([w for _, w in c.paths] for c in iso.cluster_paths(paths, 0.0)) == sorted(g[1] for g in groups)
