import itertools

import numpy as np
import pytest

from strandloom.kernels.path_graph import SINK, SOURCE, PathGraph


def built(paths):
    graph = PathGraph()
    for names, weight, *flags in paths:
        graph.add(names, weight, **(flags[0] if flags else {}))
    return graph


def all_paths(graph, node=SOURCE):
    if node == SINK:
        return [[SINK]]
    return [[node, *rest] for m in graph.after[node] for rest in all_paths(graph, m)]


@pytest.mark.parametrize("seed", range(8))
def test_first_path_is_the_widest_and_flow_goes_down(seed):
    rng = np.random.default_rng(seed)
    graph = built([(sorted(rng.choice(9, size=rng.integers(1, 6), replace=False).tolist()), float(rng.integers(1, 50))) for _ in range(7)])
    order = graph.order()
    place = {n: k for k, n in enumerate(order)}
    assert all(place[a] < place[b] for a in order for b in graph.after[a])
    best = max(min(graph.weight[n] for n in path) for path in all_paths(graph))
    found = graph.widest_paths()
    assert found[0][1] == pytest.approx(best)
    assert all(a[1] >= b[1] - 1e-6 for a, b in itertools.pairwise(found))
    assert graph.widest_paths(most=1) == found[:1]
    assert all(w > 0.5 * found[0][1] for _, w in graph.widest_paths(fraction=0.5)[1:])


def test_disjoint_paths_come_back_whole():
    graph = built([("ab", 5.0), ("cd", 3.0), ("e", 1.0)])
    assert [(p, w) for p, w in graph.widest_paths()] == [(["a", "b"], 5.0), (["c", "d"], 3.0), (["e"], 1.0)]


def test_smoothing_carries_loose_ends():
    graph = built([("abd", 6.0), ("acd", 2.0), ("a", 4.0, {"to_sink": False})])
    graph.smooth()
    assert dict(zip(graph.names, graph.weight, strict=True)) == pytest.approx({"source": 12.0, "sink": 12.0, "a": 12.0, "b": 9.0, "c": 3.0, "d": 12.0})


def test_pruning_and_empty_graphs():
    graph = built([("ab", 2.0), ("xy", 9.0, {"from_source": False}), ("z", 1.0, {"to_sink": False})])
    assert graph.prune() == 3
    assert graph.prune() == 0
    assert graph.widest_paths() == [(["a", "b"], 2.0)]
    assert PathGraph().widest_paths() == []
    assert built([("x", 3.0, {"to_sink": False})]).widest_paths() == []


def test_a_cycle_is_an_error():
    with pytest.raises(ValueError, match="cycle"):
        built([("ab", 1.0), ("ba", 1.0)]).order()


def test_operator_sums_equal_paths_and_joins_mers(spark):
    from strandloom.operators.paths import widest_paths

    schema = "g string, nodes array<long>, expr double, has_source boolean, has_sink boolean, ord long, extra int"
    rows = [("a", [1, 2, 4], 1.0, True, True, k, 0) for k in range(6)] + [("a", [1, 3, 4], 2.0, True, True, 9, 0), ("a", [1], 4.0, True, False, 10, 0), ("b", [7, 8], 3.0, True, False, 1, 0), ("c", [], 1.0, True, True, 1, 0), (None, [5], 2.0, True, True, 1, 0)]
    frame = spark.createDataFrame(rows, schema)
    one = {(r.g, r["rank"]): (r.nodes, r.expr) for r in widest_paths(frame, "g").collect()}
    assert one == {("a", 1): ([1, 2, 4], 9.0), ("a", 2): ([1, 3, 4], 3.0), (None, 1): ([5], 2.0)}
    two = {(r.g, r["rank"]): (r.nodes, r.expr) for r in widest_paths(frame, "g", k=2).collect()}
    assert two == {("a", 1): ([1, 2, 4], 6.0), ("a", 2): ([1, 3, 4], 2.0), (None, 1): ([5], 2.0)}
    assert widest_paths(frame.limit(0), "g").count() == 0
