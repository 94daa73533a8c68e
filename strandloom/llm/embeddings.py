"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are turned to the principal axes of a sample, and the first ``AXES`` coordinates are
rounded to bytes: a vector's code. Codes are split in halves; each half has its own codebook, and
the product of the two makes the grid of cells. A code lives in the cell of its nearest centroids.
A block of searches traverses the cells in ascending order of a lower bound on the distance to
anything living there (the multi-sequence order over the two sorted lists of half bounds) and
stops where the bound leaves the radius that the cosine allows; the part of a half's bound towards
another centroid's cell is the distance to the plane between the two centroids. Leaving axes out
only shortens distances, and rounding lengthens them by at most the radius's margin, so no link is
passed over: the recall is 1. Only vectors with a near code are fetched; they are verified by
cosine in double precision.

Vectors are compared only under equal labels (and of equal length). Equal vectors under a label
are one node, with a count of copies. Vectors whose codes are connected by nearness are a group;
groups are worked through in tiles of bounded size, and a tile returns, for each of its nodes, how
many vectors it links with, and a spanning forest of its links, never the pairs themselves.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those
without a label, link with nothing. Rows with the same id stand for themselves. A row without an
id has no component and is kept. The smallest id represents a component.

Scale: axes and codebooks are fitted on a bounded sample (at most ``SAMPLE`` vectors), every vector
is coded. The nodes of a label, in order of their cells, are cut in shards; all pairs of shards meet,
so the work grows with the square of a label's nodes, less what the index rules out. What travels
for it is codes, at most about eight times each (until a shard is ``64 * SHARD`` nodes); vectors
travel twice, once of them only those with near codes. The input is read several times instead of
being written again.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, sorted_groups, staged
from .components import connected_components

COSINE, SAMPLE, TILE, ROUNDS = 0.98, 32_768, 512, 8
#: Coordinates of a code, its steps to a unit, the least nodes of a shard, and the searches of a block.
AXES, STEPS, SHARD, BLOCK = 24, 127, 4096, 2048


class MultiIndex:
    """Two codebooks and the cell bounds of the product grid."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.gaps = tuple(np.sqrt(_squares(b, b)) for b in self.books)

    @staticmethod
    def fit(unit: np.ndarray, size: int, rounds: int = ROUNDS) -> MultiIndex:
        cut = unit.shape[1] // 2
        return MultiIndex(_k_means(unit[:, :cut], size, rounds), _k_means(unit[:, cut:], size, rounds))

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return unit[:, :cut], unit[:, cut:]

    def home(self, unit: np.ndarray) -> np.ndarray:
        """Cell number of each vector."""
        i, j = (_squares(h, b).argmin(axis=1) for h, b in zip(self.halves(unit), self.books, strict=True))
        return i * len(self.books[1]) + j

    def bounds(self, unit: np.ndarray) -> list[np.ndarray]:
        """Of each half, squared lower bounds on the distance to what lives at each centroid."""
        out = []
        for half, book, gap in zip(self.halves(unit), self.books, self.gaps, strict=True):
            d = _squares(half, book)
            near = d.argmin(axis=1)
            own = d[np.arange(len(d)), near][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d - own) / (2 * gap[near])
            out.append(np.where(gap[near] > 0, np.maximum(plane, 0.0), 0.0) ** 2)
        return out

    def visit(self, first: np.ndarray, second: np.ndarray, most: float) -> list[int]:
        """Multi-sequence traversal: cells in ascending order of the summed bounds, up to ``most``."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a].tolist(), second[b].tolist()
        width, out = len(second), []
        heap = [(x[0] + y[0], 0, 0)]
        while heap and heap[0][0] <= most:
            bound, i, j = heapq.heappop(heap)
            out.append(int(a[i]) * width + int(b[j]))
            if j + 1 < len(y):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :], 0.0)


def _k_means(x: np.ndarray, size: int, rounds: int) -> np.ndarray:
    pick = np.random.default_rng(11).permutation(len(x))[: min(size, len(x))]
    book = x[pick].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(x[i : i + 4096], book).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        for k in range(x.shape[1]):
            sums[:, k] = np.bincount(near, weights=x[:, k], minlength=len(book))
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


@dataclass
class Coder:
    """Codes of the unit vectors of one length, and the index over them; distances are in steps of a code."""

    axes: np.ndarray
    index: MultiIndex

    @staticmethod
    def fit(unit: np.ndarray, size: int) -> Coder:
        axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1][:, :AXES]
        return Coder(axes, MultiIndex.fit(_codes(unit, axes).astype(np.float64), size))

    @staticmethod
    def plain(size: int) -> Coder:
        """For a length of which the sample has no vector: the first coordinates, in one cell."""
        k = min(size, AXES)
        return Coder(np.eye(size, k), MultiIndex(np.zeros((1, k // 2)), np.zeros((1, k - k // 2))))

    def reach(self, cosine: float) -> float:
        """The squared distance up to which codes of linked vectors lie: each coordinate of each is rounded by half a step at most."""
        return (STEPS * math.sqrt(2.0 - 2.0 * cosine + 1e-9) + math.sqrt(self.axes.shape[1]) + 1e-3) ** 2

    def near(self, a: np.ndarray, b: np.ndarray, most: float, *, same: bool) -> np.ndarray:
        """For the codes of ``a`` and then of ``b``, the first of the group that those within ``most`` connect, or -1 for one without any; ``same``: both are one set, named once."""
        shift = 0 if same else len(a)
        top, hit = np.arange(shift + len(b)), np.zeros(shift + len(b), dtype=bool)
        home = self.index.home(b.astype(np.float64))
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        members = dict(zip(cells.tolist(), np.split(order, first[1:]), strict=True))
        # codes are whole, so products and half squares are exact in single precision
        half_a, half_b = (-(x.astype(np.float32) ** 2).sum(axis=1, keepdims=True) / 2 for x in (a, b))
        left, right = np.hstack((a, half_a, np.ones_like(half_a))).astype(np.float32), np.hstack((b, np.ones_like(half_b), half_b)).astype(np.float32)
        for at in range(0, len(a), BLOCK):
            one, two = self.index.bounds(a[at : at + BLOCK].astype(np.float64))
            for cell in self.index.visit(one.min(axis=0), two.min(axis=0), most):
                if cell not in members:
                    continue
                i, j = divmod(cell, two.shape[1])
                seek = np.flatnonzero(one[:, i] + two[:, j] <= most) + at
                for k in range(0, len(members[cell]), BLOCK) if len(seek) else ():
                    live = members[cell][k : k + BLOCK]
                    x, y = np.nonzero(left[seek] @ right[live].T >= -most / 2)
                    x, y = seek[x], live[y] + shift
                    apart = x != y
                    _join(top, x[apart], y[apart])
                    hit[x[apart]] = hit[y[apart]] = True
        return np.where(hit, _roots(top, np.arange(len(top))), -1)


def _roots(top: np.ndarray, at: np.ndarray) -> np.ndarray:
    while (top[at] != at).any():
        at = top[at]
    return at


def _join(top: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Unite the trees of each pair of nodes; a root is its tree's smallest node."""
    while len(x):
        x, y = _roots(top, x), _roots(top, y)
        x, y = (v[x != y] for v in (np.maximum(x, y), np.minimum(x, y)))
        np.minimum.at(top, x, y)


def _codes(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return np.rint(unit @ axes * STEPS).astype(np.int8)


def _packed(v: np.ndarray) -> bytes:
    """A vector's bytes: 4 and single precision where that is exact, else 8 and double."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return b"4" + single.tobytes() if (single == v).all() else b"8" + v.tobytes()


def _clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(_id, label, size, vec, node): ``vec`` and ``node`` null where the vector links with nothing."""

    def run(batches):
        for batch in batches:
            column, labels = batch.column("_vec"), batch.column("_label").to_pylist()
            flat, at = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64), 0
            out, sizes = [], []
            for n, label in zip(column.value_lengths().to_pylist(), labels, strict=True):
                v = flat[at : at + (n or 0)]
                at += n or 0
                good = label is not None and n and np.isfinite(v).all() and np.any(v)
                out.append(_packed(v + 0.0) if good else None)
                sizes.append(n or 0)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["_id", "label", "size", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vector_col).cast("array<double>").alias("_vec"))
    return rows.mapInArrow(run, "_id long, label string, size int, vec binary").withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(v, dtype=f"<f{v[:1].decode()}", offset=1) for v in packed], dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def embedding_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    cleaned = _clean(vectors, id_col, vector_col, label_col)
    rows = staged(cleaned.select("_id", "label", "size", "node"), "vectors-rows")
    good = cleaned.where("node IS NOT NULL")
    coders = vectors.sparkSession.sparkContext.broadcast(_coders(rows.where("node IS NOT NULL"), good, sample))
    nodes = staged(_coded(good, coders), "vectors-nodes")
    near = staged(_near(nodes, coders, cosine), "vectors-near")
    found = staged(_tiles(near, good, nodes.select("node", "copies"), cosine), "vectors-found")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("n").alias("links")).select(F.col("a").alias("node"), "links")
    components = connected_components(found.where("kind = 1").select("a", F.col("n").alias("b")))
    own = staged(nodes.select("node", "least").join(links, "node").join(components, "node"), "vectors-own")
    smallest = own.groupBy("component").agg(F.min("least").alias("smallest"))
    named = own.join(smallest, "component").select("node", "links", "smallest")
    every = nodes.select("node", "least", "copies").join(named, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("smallest"))
    out = rows.select("_id", "node").join(every, "node", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("smallest", "_id"))
    return out.select(F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def _coders(rows: DataFrame, good: DataFrame, sample: int) -> dict[int, Coder]:
    """A coder for each vector length, fitted on at most about ``sample`` vectors in all; a label's cells hold some 64 vectors."""
    n, labels = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    share = min(1.0, sample / max(1, n))
    chosen = good.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("size", "vec").limit(2 * sample)
    by_length: dict[int, list[bytes]] = {}
    for size, vec in chosen.toLocalIterator():
        by_length.setdefault(size, []).append(bytes(vec))
    return {k: Coder.fit(_unit(v), max(1, min(1024, round((n / max(1, labels) / 64) ** 0.5)))) for k, v in by_length.items()}


def _coded(good: DataFrame, coders: Broadcast[dict[int, Coder]]) -> DataFrame:
    """Nodes (node, label, size, code, cell, least, copies): the codes of distinct vectors travel, not the vectors."""

    def run(batches):
        for batch in batches:
            vec, sizes = batch.column("vec").to_pylist(), batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                coder = coders.value.get(size) or Coder.plain(size)
                codes = _codes(_unit([vec[i] for i in at]), coder.axes)
                kept = [batch.column(c).take(pa.array(at)) for c in ("_id", "node", "label", "size")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(coder.index.home(codes.astype(np.float64)), pa.int64())], ["_id", "node", "label", "size", "code", "cell"])

    made = good.select("_id", "node", "label", "size", "vec").mapInArrow(run, "_id long, node long, label string, size int, code binary, cell long")
    # equal vectors may be coded in different batches, where the last bit of a product may differ
    one = F.min(F.struct("label", "size", "code", "cell")).alias("one")
    return made.groupBy("node").agg(one, F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies")).select("node", "one.*", "least", "copies")


def _near(nodes: DataFrame, coders: Broadcast[dict[int, Coder]], cosine: float) -> DataFrame:
    """(pair, group, side, node): groups of near codes in a pair of shards; 0 and 1 are the two shards' sides, 2 is a shard by itself."""
    keys = ["label", "size"]
    counted = nodes.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy(*keys))
    cells = counted.select(*keys, "cell", "n", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), total.alias("total"))
    cells = cells.withColumn("width", F.greatest(F.lit(SHARD), F.least(F.lit(64 * SHARD), F.ceil(F.col("total") / 8))))
    # a node's place among its label's is its cell's, and anywhere within the cell: a large cell is cut as well
    place = F.col("before") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("n"))
    placed = nodes.select(*keys, "cell", "node", "code").join(cells, [*keys, "cell"]).select(*keys, "node", "code", F.floor(place / F.col("width")).alias("s"), F.floor((F.col("total") - 1) / F.col("width")).alias("last"))
    met = placed.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    side = F.when(F.col("s") == F.col("t"), 2).when(F.col("s") < F.col("t"), 0).otherwise(1)
    dealt = met.select(F.xxhash64(*keys, F.least("s", "t"), F.greatest("s", "t")).alias("pair"), side.alias("side"), "size", "node", "code").repartition("pair").sortWithinPartitions("pair")

    def run(batches):
        for (pair,), group in sorted_groups(batches, 1):
            side, node, size = group.column("side").to_numpy(), group.column("node").to_numpy(), group.column("size")[0].as_py()
            coder = coders.value.get(size) or Coder.plain(size)
            code = np.frombuffer(b"".join(group.column("code").to_pylist()), dtype=np.int8).reshape(len(node), -1)
            parts = [np.flatnonzero(side == k) for k in ((2, 2) if side[0] == 2 else (0, 1))]
            if not all(map(len, parts)):
                continue
            who = np.concatenate(parts[: 1 if side[0] == 2 else 2])
            group = coder.near(code[parts[0]], code[parts[1]], coder.reach(cosine), same=side[0] == 2)
            kept = np.flatnonzero(group >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), pair)), pa.array(node[who[group[kept]]]), pa.array(side[who[kept]].astype(np.int32)), pa.array(node[who[kept]])], ["pair", "group", "side", "node"])

    return dealt.mapInArrow(run, "pair long, group long, side int, node long")


def _tiles(near: DataFrame, good: DataFrame, copies: DataFrame, cosine: float) -> DataFrame:
    """Rows (kind, a, n): 0, a node and the vectors it links with in a tile; 1, an edge (a, n) of a tile's forest."""
    tiles = lambda sides: F.ceil(F.count_if(F.col("side").isin(*sides)) / TILE).cast("int")
    sizes = near.groupBy("pair", "group").agg(tiles([0, 2]).alias("across"), tiles([1, 2]).alias("down"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("side") == 1, F.col("down")).otherwise(F.col("across"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("down")).otherwise(F.col("across")) - 1))
    placed = near.join(sizes, ["pair", "group"]).withColumn("own", own).withColumn("other", other)
    # in a shard by itself, tile (x, y) stands for (y, x) too
    x = F.when(F.col("side") == 0, F.col("own")).when(F.col("side") == 1, F.col("other")).otherwise(F.least("own", "other"))
    y = F.when(F.col("side") == 0, F.col("other")).when(F.col("side") == 1, F.col("own")).otherwise(F.greatest("own", "other"))
    turn = F.when((F.col("side") == 2) & (F.col("own") != F.col("other")), (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    placed = placed.select("pair", "group", x.alias("x"), y.alias("y"), turn.alias("side"), "node")

    def run(batches):
        for _, group in sorted_groups(batches, 4):
            side, node, n = (group.column(c).to_numpy() for c in ("side", "node", "copies"))
            packed = group.column("vec").to_pylist()
            alone = side[0] == 2
            p, m = (np.flatnonzero(side == k) for k in ((2, 2) if alone else (0, 1)))
            if not len(p) or not len(m):
                continue
            linked = _unit([packed[i] for i in p]) @ _unit([packed[i] for i in m]).T >= cosine
            if alone:
                linked = linked | linked.T  # a product's last bit may hang on its side
                np.fill_diagonal(linked, False)
            counts = [(node[p], linked @ n[m])] + ([] if alone else [(node[m], n[p] @ linked)])
            who, links = (np.concatenate(v) for v in zip(*counts, strict=True))
            hit = np.flatnonzero(links)
            if len(hit):
                a, b = _forest(linked, node[p], node[m])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.zeros(len(hit)), np.ones(len(a)))).astype(np.int32)), pa.array(np.concatenate((who[hit], a))), pa.array(np.concatenate((links[hit], b)))], ["kind", "a", "n"])

    wanted = near.select("node").distinct().join(copies, "node")
    vectors = good.select("node", "vec").join(wanted, "node").groupBy("node").agg(F.first("vec").alias("vec"), F.first("copies").alias("copies"))
    dealt = placed.join(vectors, "node").select("pair", "group", "x", "y", "side", "node", "vec", "copies").repartition("pair", "group", "x", "y").sortWithinPartitions("pair", "group", "x", "y")
    return dealt.mapInArrow(run, "kind int, a long, n long")


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the components of a tile's links: (smallest node, other node)."""
    todo = linked.any(axis=1)
    a, b = [], []
    while todo.any():
        rows = np.zeros(len(left), dtype=bool)
        rows[np.flatnonzero(todo)[0]] = True
        while True:
            columns = linked[rows].any(axis=0)
            grown = linked[:, columns].any(axis=1)
            if (grown == rows).all():
                break
            rows = grown | rows
        names = np.unique(np.concatenate((left[rows], right[columns])))
        a.append(np.full(len(names) - 1, names[0]))
        b.append(names[1:])
        todo &= ~rows
    return np.concatenate(a), np.concatenate(b)
