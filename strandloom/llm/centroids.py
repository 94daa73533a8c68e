"""Clustering of embeddings around centroids by annulus search, in whole numbers.

Entries become integers floor(``scale`` * x), so that means, distances and ties are exact and every
run gives the same clusters. Centroids are sorted by norm. The distance to the centroid whose norm is
closest to a vector's own is an upper bound u on the distance to its nearest one; by the triangle
inequality that one's norm lies between |x| - u and |x| + u, bounds included. Two binary searches
find this annulus, and only the centroids in it are compared exactly; equal distances go to the
smaller number. Vectors are compared in blocks that share nearly the same annulus.

Defined results: vectors of another length than ``dims``, null ones and those with null or
non-finite entries are left out, as are those with an entry whose integer passes 2^62. With fewer
vectors than ``k`` there are as many centroids as vectors; an empty table gives no rows. Repeated
ids stay separate rows and separate vectors; of equal hashes the smaller vector comes first; a null
id hashes as the empty text. A distance or sum too large for a long is null.

Scale: each round is one pass over the table. A task returns k * dims partial sums, which Spark adds
up; the driver holds k centroids. No row is shuffled or written but the final (id, cluster, distance).
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

K, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, "2:"
#: Vectors compared at once: their annuli are nearly equal.
BLOCK = 1024
#: Largest entries for which a squared distance is exact in doubles, and fits a long.
_DOUBLE, _LONG, _MOST = 1 << 22, 1 << 27, 1 << 62


def dense(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lists with exactly ``dims`` entries, all finite, and their entries as a matrix."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = np.flatnonzero(lengths == dims)
    rows = flat[(np.cumsum(lengths) - lengths)[at][:, None] + np.arange(dims)]
    good = np.isfinite(rows).all(axis=1)
    return at[good], rows[good]


def whole(rows: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have integers that fit, and floor(scale * x) of those."""
    with np.errstate(over="ignore"):
        scaled = np.floor(rows * scale)
    good = (np.abs(scaled) <= _MOST).all(axis=1)
    return good, scaled[good].astype(np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances: in doubles, longs or Python's integers, as the size of the entries asks."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if most <= _DOUBLE else np.int64 if most <= _LONG else object
    x, c = x.astype(kind), c.astype(kind)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return found.astype(np.int64) if kind is np.float64 else found


class Annulus:
    """Centroids sorted by norm, searched for the nearest of each vector."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.number], centroids[self.number]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place of the centroids whose norm lies in each vector's annulus."""
        rows = x.astype(np.float64)
        norm = np.sqrt((rows * rows).sum(axis=1))
        right = np.clip(np.searchsorted(self.norms, norm), 0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        probe = np.where(norm - self.norms[left] < self.norms[right] - norm, left, right)
        gap = rows - self.sorted[probe].astype(np.float64)
        upper = np.sqrt((gap * gap).sum(axis=1))
        slack = 1e-9 * (norm + upper) + 1e-6  # far above the rounding of norms, so that no tie at the rim is lost
        return np.searchsorted(self.norms, norm - upper - slack), np.searchsorted(self.norms, norm + upper + slack, side="right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector."""
        first, last = self.bounds(x)
        cluster, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=object)
        large = np.abs(x).max(axis=1, initial=0) > _DOUBLE
        order = np.lexsort((last, first, large))
        split = len(x) - int(large.sum())
        starts = [*range(0, split, BLOCK), *range(split, len(x), BLOCK), len(x)]
        for a, b in zip(starts, starts[1:], strict=False):
            rows = order[a:b]
            low, high = first[rows].min(), last[rows].max()
            d = _squares(x[rows], self.sorted[low:high])
            best = d.min(axis=1)
            cluster[rows] = np.where(d == best[:, None], self.number[low:high][None, :], len(self.number)).min(axis=1)
            distance[rows] = best
        return cluster, distance


def _vectors(batches, dims: int, scale: int):
    """(batch, positions kept, integers) of each batch with a row to keep."""
    for batch in batches:
        at, rows = dense(batch.column("_vec"), dims)
        good, x = whole(rows, scale)
        if len(x):
            yield batch, at[good], x


def _first_centroids(rows: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    def run(batches):
        for batch, at, x in _vectors(batches, dims, scale):
            keys = batch.column("_key").take(pa.array(at)).to_pylist()
            best = sorted(range(len(at)), key=lambda i: (keys[i], x[i].tolist()))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in best], pa.string()), pa.array([x[i].tolist() for i in best], pa.list_(pa.int64()))], ["key", "x"])

    keyed = rows.withColumn("_key", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256))
    chosen = keyed.mapInArrow(run, "key string, x array<long>").orderBy("key", "x").limit(k).collect()
    return np.array([r.x for r in chosen], dtype=np.int64).reshape(len(chosen), dims)


def _moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: every vector goes to its nearest centroid, which becomes the floored mean of its vectors."""
    k, dims = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        search = Annulus(shared.value)
        sums, n = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=np.int64)
        for _, _, x in _vectors(batches, dims, scale):
            cluster, _ = search.nearest(x)
            n += np.bincount(cluster, minlength=k)
            small = np.abs(x).max(axis=1) <= _DOUBLE
            member = np.zeros((k, int(small.sum())))
            member[cluster[small], np.arange(member.shape[1])] = 1.0
            sums += (member @ x[small].astype(np.float64)).astype(np.int64)
            for i in np.flatnonzero(~small).tolist():
                sums[cluster[i]] += x[i].astype(object)
        held = np.flatnonzero(n)
        if len(held):
            columns = [np.repeat(held, dims), np.tile(np.arange(dims), len(held)), np.repeat(n[held], dims)]
            total = pa.array([Decimal(int(s)) for s in sums[held].ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), total], ["cluster", "dim", "n", "total"])

    parts = rows.mapInArrow(run, "cluster long, dim long, n long, total decimal(38,0)")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.cluster, r.dim] = int(r.total) // r.n
    shared.unpersist()
    return out


def cluster_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """Per vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vec"))
    centroids = _first_centroids(rows, k, dims, scale, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(rows, centroids, scale)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches):
        search = Annulus(shared.value)
        for batch, at, x in _vectors(batches, dims, scale):
            cluster, distance = search.nearest(x)
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at)), pa.array(cluster.astype(np.int32)), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    out = staged(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "centroids-assigned")
    total = F.when(F.count(F.lit(1)) == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r.cluster: r.total for r in out.groupBy("cluster").agg(total.alias("total")).collect()}
    whole_sum = None if None in inertia.values() else sum(inertia.values())
    long = lambda v: int(v) if v is not None and v < 1 << 63 else None
    named = [(c, long(v), long(whole_sum), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, v in inertia.items()]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
