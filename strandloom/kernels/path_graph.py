"""Graphs of weighted paths between a source and a sink: order, pruning, smoothing and widest paths.

A node is anything hashable; nodes are numbered as they are first seen, SOURCE and SINK before all.
Weights are summed in double precision, flows in single precision, as the results' contract needs.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from itertools import pairwise

import numpy as np

SOURCE, SINK = 0, 1
#: Fixed value: the least flow a node keeps, and the least a path must carry.
FLOOR = np.float32(1e-10)
NOTHING = np.float32(0)


class PathGraph:
    """Adjacency, node weights, and what enters and leaves at each node."""

    def __init__(self) -> None:
        self.names: list[Hashable] = ["source", "sink"]
        self.after: list[dict[int, None]] = [{}, {}]
        self.before: list[dict[int, None]] = [{}, {}]
        self.weight = [0.0, 0.0]
        self.enters = [np.float32(0), np.float32(0)]
        self.leaves = [np.float32(0), np.float32(0)]
        self._number: dict[Hashable, int] = {}
        self._order: list[int] | None = None

    def number(self, name: Hashable) -> int:
        if name not in self._number:
            self._number[name] = len(self.names)
            self.names.append(name)
            self.after.append({})
            self.before.append({})
            self.weight.append(0.0)
            self.enters.append(NOTHING)
            self.leaves.append(NOTHING)
        return self._number[name]

    def add(self, names: Iterable[Hashable], weight: float, *, from_source: bool = True, to_sink: bool = True) -> None:
        self._order = None
        known = self._number
        nodes = [SOURCE] * from_source + [known[n] if n in known else self.number(n) for n in names] + [SINK] * to_sink
        if not nodes:
            return
        after, before, weights = self.after, self.before, self.weight
        weights[nodes[0]] += weight
        for a, b in pairwise(nodes):
            after[a][b] = None
            before[b][a] = None
            weights[b] += weight
        self.leaves[nodes[0]] += np.float32(weight)
        self.enters[nodes[-1]] += np.float32(weight)

    def __len__(self) -> int:
        return len(self._number)

    def numbers(self) -> list[int]:
        """The nodes that are left, without source and sink."""
        return sorted(self._number.values())

    def gain(self, node: int, weight: float) -> None:
        """Weight that enters and leaves at a node, as of a path of which no more is known."""
        self.weight[node] += weight
        self.enters[node] += np.float32(weight)
        self.leaves[node] += np.float32(weight)

    def connected(self) -> bool:
        """Whether a way leads from source to sink, by walking from both ends, the smaller front first, until they meet."""
        seen = {SOURCE: {SOURCE}, SINK: {SINK}}
        edge, steps = {SOURCE: [SOURCE], SINK: [SINK]}, {SOURCE: self.after, SINK: self.before}
        while edge[SOURCE] and edge[SINK]:
            side = SOURCE if len(edge[SOURCE]) <= len(edge[SINK]) else SINK
            front = {m for n in edge[side] for m in steps[side][n]} - seen[side]
            if front & seen[SOURCE + SINK - side]:
                return True
            seen[side] |= front
            edge[side] = list(front)
        return False

    def prune(self) -> int:
        """Take out nodes that lie on no way from source to sink; how many."""
        useful = self._reach(SOURCE, self.after) & self._reach(SINK, self.before)
        lost = sorted(n for n in self._number.values() if n not in useful)
        self._order = None
        for n in lost:
            for m in self.after[n]:
                del self.before[m][n]
            for m in self.before[n]:
                del self.after[m][n]
            self.after[n], self.before[n], self.weight[n] = {}, {}, 0.0
            self.enters[n] = self.leaves[n] = np.float32(0)
            del self._number[self.names[n]]
        return len(lost)

    @staticmethod
    def _reach(start: int, steps: Sequence[dict[int, None]]) -> set[int]:
        seen, edge = {start}, [start]
        while edge:
            edge = [m for m in {m for n in edge for m in steps[n]} if m not in seen]
            seen.update(edge)
        return seen

    def order(self) -> list[int]:
        """Nodes, each before its successors, by depth first search that takes the latest made successor first; a cycle is an error."""
        if self._order is not None:
            return self._order
        done: dict[int, bool] = {}
        out: list[int] = []
        for root in (SOURCE, SINK, *sorted(self._number.values())):
            stack = [] if root in done else [(root, iter(sorted(self.after[root], reverse=True)))]
            done.setdefault(root, False)
            while stack:
                node, rest = stack[-1]
                step = next((m for m in rest if not done.get(m, False)), None)
                if step is None:
                    done[node] = True
                    out.append(node)
                    stack.pop()
                elif step in done:
                    raise ValueError("the path graph has a cycle")
                else:
                    done[step] = False
                    stack.append((step, iter(sorted(self.after[step], reverse=True))))
        self._order = out[::-1]
        return self._order

    def smooth(self) -> None:
        """Carry what ends inside the graph on to the sink, and what begins inside back to the source, by the neighbours' weights."""
        order = self.order()
        gained = [self._carry(order, self.after, self.enters), self._carry(order[::-1], self.before, self.leaves)]
        self.weight = [w + float(a) + float(b) for w, a, b in zip(self.weight, *gained, strict=True)]

    def _carry(self, order: list[int], steps: list[dict[int, None]], held: list[np.float32]) -> np.ndarray:
        held = np.array(held, dtype=np.float32)
        gained = np.zeros_like(held)
        for n in order:
            if steps[n] and held[n]:
                to = np.array(sorted(steps[n]), dtype=np.int64)
                weights = [self.weight[m] for m in to]
                total = sum(weights)
                share = np.array([w / total * float(held[n]) if total else float(held[n]) / len(to) for w in weights]).astype(np.float32)
                gained[to] += share
                held[to] += share
        return gained

    def widest_paths(self, fraction: float = 0.0, most: int = 0) -> list[tuple[list[Hashable], float]]:
        """Paths by falling flow, each taken out of the graph before the next; they end below ``fraction`` of the first (or after ``most``)."""
        flow = np.array(self.weight, dtype=np.float32)
        if flow[SOURCE] < FLOOR or SINK not in self._reach(SOURCE, self.after):
            return []
        order, found, least = self.order(), [], None
        flows = flow.tolist()  # single precision is exact in Python's floats, which compare faster
        while not most or len(found) < max(most, 1):
            width = [float(FLOOR)] * len(flows)
            width[SOURCE], came = flows[SOURCE], {}
            for n in order:
                for m in self.after[n] if n == SOURCE or n in came else ():
                    w = min(width[n], flows[m])
                    if m not in came or w > width[m]:
                        width[m], came[m] = w, n
            if least is not None and width[SINK] <= least:
                break
            nodes = [SINK]
            while nodes[-1] != SOURCE:
                nodes.append(came[nodes[-1]])
            if least is None:
                least = float(max(np.float32(width[SINK]) * np.float32(fraction), FLOOR))
            found.append(([self.names[n] for n in nodes[-2:0:-1]], float(width[SINK])))
            flow[nodes] = np.maximum(flow[nodes] - np.float32(width[SINK]), FLOOR)
            for n, left in zip(nodes, flow[nodes].tolist(), strict=True):
                flows[n] = left
        return found
