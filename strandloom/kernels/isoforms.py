"""From a splice graph to isoforms: the choice of k, rescue of short walks, widest paths, clusters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, cached_property

import numpy as np

from .path_graph import PathGraph
from .splice_graph import Frag, Guide, SpliceGraph, Walk
from .suffixes import SuffixIndex


@dataclass(frozen=True)
class AssemblySettings:
    """``isoform_share``: least flow of an isoform against the best of any gene; 0 as ``k_most``, ``most_paths`` or ``most_isoforms`` is no limit."""

    isoform_share: float = 0.05
    most_isoforms: int = 0
    change_points: bool = True
    p: float = 0.01
    fold: float = 0.85
    trim: bool = True
    k_most: int = 0
    path_share: float = 0.0
    most_paths: int = 0
    unstranded: bool = False
    guide: Guide = field(default_factory=Guide)


@dataclass
class KGraph:
    """The path graph for one k, and the walks that are too short for it."""

    k: int
    graph: PathGraph
    short: list[Walk]
    lost: int
    weight: float

    @cached_property
    def valid(self) -> bool:
        return self.graph.connected()

    def kmers(self) -> int:
        return len(self.graph)


def k_graph(walks: list[Walk], k: int) -> KGraph:
    """K-mers of all walks; one shorter than k counts whole if it runs from source to sink, and is set aside otherwise."""
    graph, short, weight = PathGraph(), [], 0.0
    for w in walks:
        if len(w.nodes) < k and not (w.from_source and w.to_sink):
            short.append(w)
            continue
        nodes = tuple(w.nodes)
        graph.add([nodes[i : i + k] for i in range(max(len(nodes) - k, 0) + 1)], w.frag.expr, from_source=w.from_source, to_sink=w.to_sink)
        weight += w.frag.expr
    lost = graph.prune()
    found = KGraph(k, graph, short, lost, weight)
    if not found.valid:  # without a way through, source and sink are lost too
        found.lost += 2
    return found


def best_of_range(most: int, score: Callable[[int], int]) -> int:
    """An argument from 1 to ``most`` of high score, by bisection; of equal scores the smaller.

    The better of a point and the middles of its two sides is followed until at most four arguments
    are left. The score need not be monotone, so it is a search, not a proof of the maximum.
    """
    score = cache(score)
    low, high, at = 1, most, (1 + most) // 2
    while high - low > 3:
        left, right = (low + at) // 2, (at + high) // 2
        best = max((left, at, right), key=score)
        if best == left:
            low, at, high = low, left, at
        elif best == at:
            low, at, high = left, at, right
        else:
            low, at, high = at, right, high
    return max(range(low, high + 1), key=score)


def choose_k(walks: list[Walk], k_most: int = 0) -> tuple[KGraph, list[dict]]:
    """The graph of the best k, and a row for every k tried and for the choice.

    A k scores the number of k-mers weighted by the share of expression in its graph, and -k if no
    way leads through. Short walks are rescued into the graph that is chosen.
    """
    total = sum(w.frag.expr for w in walks)
    most = max(1, max(len(w.nodes) for w in walks))
    most = min(k_most, most) if k_most else most
    rows: list[dict] = []
    graphs: dict[int, KGraph] = {}

    def row(g: KGraph, lost: tuple[int, float], chosen: bool) -> int:
        share = g.weight / total if total else 0.0
        score = math.floor(share * g.kmers() + 0.5)
        rows.append({"k": g.k, "k_most": most, "transfrags": sum(w.frag.n for w in walks), "short": sum(w.frag.n for w in g.short), "short_expr": sum(w.frag.expr for w in g.short), "lost_short": lost[0], "lost_short_expr": lost[1], "kmers": g.kmers(), "lost_kmers": g.lost, "total_expr": total, "graph_expr": g.weight, "share": share, "valid": g.valid, "score": score, "chosen": chosen})
        return score

    def tried(k: int) -> int:
        g = graphs[k] = k_graph(walks, k)
        score = row(g, (0, 0.0), False)
        return score if g.valid else -k

    best = graphs[best_of_range(most, tried)]
    row(best, rescue(best), True)
    return best, rows


def rescue(g: KGraph) -> tuple[int, float]:
    """Add short walks to the k-mers that contain them, by these k-mers' weight before any is added; what finds none is (number, expression)."""
    if not g.short:
        return 0, 0.0
    numbers = g.graph.numbers()
    index = SuffixIndex([g.graph.names[n] for n in numbers])
    before, gains, lost, lost_expr = list(g.graph.weight), [], 0, 0.0
    for w in g.short:
        hits = [numbers[k] for k in index.find(w.nodes)]  # a k-mer that holds it twice counts twice
        total = sum(before[n] for n in hits)
        if not hits:
            lost, lost_expr = lost + w.frag.n, lost_expr + w.frag.expr
        gains += [(n, w.frag.expr * (before[n] / total) if total else w.frag.expr / len(hits)) for n in hits]
    for n, amount in gains:
        g.graph.gain(n, amount)
    return lost, lost_expr


@dataclass
class Cluster:
    """Paths that share nodes, by falling flow."""

    paths: list[tuple[list[int], float]]
    flow: float = 1e-10  #: fixed value: the flow of a cluster without paths


def cluster_paths(paths: list[tuple[list[int], float]], share: float) -> list[Cluster]:
    """Paths, in the order given, to clusters that share nodes; a path that touches several joins them at the first.

    A path that touches a cluster is dropped if its flow is below ``share`` of the first path of any
    cluster, touched or not; one that touches none begins a cluster whatever its flow.
    """
    owner: dict[int, int] = {}
    clusters: dict[int, Cluster] = {}
    made = 0
    for nodes, flow in paths:
        touched = sorted({owner[n] for n in nodes if n in owner})
        lead = max((c.paths[0][1] for c in clusters.values()), default=0.0)
        if touched and (flow / lead if lead else 0.0) < share:
            continue
        home = touched[0] if touched else made
        made += home == made
        into = clusters.setdefault(home, Cluster([]))
        for other in touched[1:]:
            gone = clusters.pop(other)
            into.flow += gone.flow
            into.paths += gone.paths
            owner.update((n, home) for path, _ in gone.paths for n in path)
        into.paths.sort(key=lambda p: -p[1])
        into.paths.append((nodes, flow))
        into.flow += flow
        owner.update((n, home) for n in nodes)
    return [clusters[k] for k in sorted(clusters)]


def _lone(strand: str, frag: Frag) -> dict | None:
    """The isoform of one plain frag by itself, as its graph would give it; None where that is not plain to see."""
    edges = [p for e in frag.exons for p in e]
    flow = float(np.float32(frag.expr))
    if frag.known or strand not in ("+", "-") or not flow >= 1e-6 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        return None
    return {"part": 0, "graph_start": edges[0], "graph_end": edges[-1], "gene": 0, "rank": 0, "site": 0, "exons": [{"start": a, "end": b} for a, b in frag.exons], "flow": flow, "share": 1.0, "gene_share": flow / (Cluster([]).flow + flow)}


def assemble(strand: str, frags: list[Frag], settings: AssemblySettings, *, isoforms_only: bool = False) -> dict[str, list[dict]]:
    """Rows by kind (cover, node, change, tried, isoform) of one strand's frags, which may fall into several parts.

    Isoforms carry their part, their gene within it and their start site's number within the gene.
    ``isoforms_only``: the other kinds stay empty where isoforms do not need them.
    """
    if isoforms_only:
        lone = _lone(strand, frags[0]) if len(frags) == 1 else None
        if lone or strand not in ("+", "-") and not settings.unstranded:
            return {"isoform": [lone] if lone else []}
    whole = SpliceGraph(strand, frags, settings.guide)
    out: dict[str, list[dict]] = {kind: [] for kind in ("cover", "node", "change", "tried", "isoform")}
    if not isoforms_only:
        starts, ends, values = whole.coverage.runs()
        out["cover"] = [{"start": a, "end": b, "value": v} for a, b, v in zip(starts.tolist(), ends.tolist(), values.tolist(), strict=True)]
    if strand not in ("+", "-") and not settings.unstranded:
        return out
    for part, graph in enumerate(whole.parts() if whole.walks else []):
        found = graph.changes(settings.p, settings.fold) if settings.change_points else []
        place = {"part": part, "graph_start": graph.low, "graph_end": graph.high}
        out["change"] += [{**place, "pos": c.pos, "start": c.start, "end": c.end, "sign": float(c.sign), "p": c.p, "ratio": c.ratio} for c in found]
        if found:
            graph = graph.changed(found, trim=settings.trim)
            place |= {"graph_start": graph.low, "graph_end": graph.high}
        out["node"] += [] if isoforms_only else [{**place, **row} for row in graph.node_rows()]
        best, tried = choose_k(graph.walks, settings.k_most)
        out["tried"] += [{**place, "at": at, **row} for at, row in enumerate(tried)]
        if not best.valid or not best.kmers():
            continue
        best.graph.smooth()
        flows = [([*mers[0], *(m[-1] for m in mers[1:])], flow) for mers, flow in best.graph.widest_paths(settings.path_share, settings.most_paths)]
        for gene, cluster in enumerate(cluster_paths(flows, settings.isoform_share)):
            lead, sites = cluster.paths[0][1], {}
            for rank, (nodes, flow) in enumerate(cluster.paths[: settings.most_isoforms or None]):
                exons = graph.exons(nodes)
                site = exons[-1][1] if strand == "-" else exons[0][0]
                out["isoform"].append({**place, "gene": gene, "rank": rank, "site": sites.setdefault(site, len(sites)), "exons": [{"start": a, "end": b} for a, b in exons], "flow": flow, "share": flow / lead if lead else 0.0, "gene_share": flow / cluster.flow if cluster.flow else 0.0})
    return out
