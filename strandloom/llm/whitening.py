"""Whitening of embeddings: principal components of unit variance, by a distributed SVD.

Entries c become integers x = floor(``scale`` * c) + ``offset``. With n vectors and the sums S of each
dimension, n * x - S is exact; divided by n it is the centred row. MLlib's ``computeSVD`` takes the
centred rows as a distributed matrix; its right singular vectors are the components, and a singular
value s gives the eigenvalue s * s / n (divisor n). The total variance is not taken from the SVD: it is
the sum over rows of their exact deviations, over n cubed.

Defined results: null vectors and those with null or non-finite entries are left out, as are those
with an entry whose integer passes 2^62. If lengths differ, the commonest length is kept (of equally
common ones the longer). Repeated ids stay separate rows and vectors; a null id stays null. Components
whose eigenvalue is below 1e-14 of the largest, or zero, cannot be whitened and give no rows: an empty table,
one vector, or only equal vectors give none. A deviation too large for a long is null there and
whole in ``deviation_exact``.

Scale: three passes over the table (sums, SVD, projection); nothing is shuffled but partial sums of one
row a dimension and task. The driver holds a matrix of dims * dims. Only ids, deviations and the
projected rows are written.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import dense
from .common import staged

COMPONENTS, SCALE, OFFSET = 8, 1024, 100_000
#: Singular values below this share of the largest are rounding noise of the Gramian.
NOISE = 1e-7
_LIMB = 10**18


def _integers(column: pa.Array, dims: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    at, rows = dense(column, dims)
    with np.errstate(over="ignore"):
        scaled = np.floor(rows * scale)
    good = (np.abs(scaled) <= 2.0**62).all(axis=1)
    return at[good], scaled[good].astype(np.int64) + offset


def _scaled_gap(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in longs where they hold it, in Python's integers beyond."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if most < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _deviations(gap: np.ndarray) -> list[int]:
    """Exact sums of squares of each row; two limbs of 25 bits keep up to 64 bits of every partial sum in longs."""
    if gap.dtype == object or gap.shape[1] > 4096 or np.abs(gap).max(initial=0) >= 1 << 50:
        return [sum(int(v) * int(v) for v in row) for row in gap]
    high, low = gap >> 25, gap & ((1 << 25) - 1)
    parts = ((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist())
    return [(a << 50) + (b << 26) + c for a, b, c in zip(*parts, strict=True)]


def _sums(rows: DataFrame, scale: int, offset: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension) over the vectors of the commonest length."""

    def run(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column("_vec")
            for dims in np.unique(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist():
                x = _integers(column, dims, scale, offset)[1] if dims else np.zeros((0, 0), dtype=np.int64)
                if len(x):
                    n, sums = found.get(dims, (0, np.zeros(dims, dtype=object)))
                    fits = int(np.abs(x).max()) * len(x) < 1 << 62
                    found[dims] = (n + len(x), sums + x.astype(np.int64 if fits else object).sum(axis=0))
        for dims, (n, sums) in found.items():
            columns = [np.full(dims, dims), np.arange(dims), np.full(dims, n)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], ["dims", "dim", "n", "total"])

    parts = rows.mapInArrow(run, "dims long, dim long, n long, total decimal(38,0)")
    sums = staged(parts.groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "whitening-sums")
    first = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not first:
        return 0, []
    return first[0].n, [int(r.total) for r in sums.where(F.col("dims") == first[0].dims).orderBy("dim").collect()]


def _components(rows: DataFrame, n: int, sums: list[int], most: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of the covariance, by falling eigenvalue."""
    dims = len(sums)

    def run(batches):
        for batch in batches:
            centred = (_scaled_gap(_integers(batch.column("_vec"), dims, scale, offset)[1], n, sums) / n).astype(np.float64)
            offsets = np.arange(0, centred.size + 1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, centred.ravel())], ["_vec"])

    centred = rows.mapInArrow(run, "_vec array<double>").select(array_to_vector("_vec").alias("_row"))
    # all components are asked for: then the Gramian is decomposed whole, to double precision, not by iteration
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "_row"), n, dims).computeSVD(dims, computeU=False, rCond=NOISE)
    values = svd.s.toArray() ** 2 / n
    keep = min(most, int((values > 0).sum()))
    return values[:keep], svd.V.toArray()[:, :keep]


def _project(rows: DataFrame, n: int, sums: list[int], weights: np.ndarray, scale: int, offset: int) -> DataFrame:
    """(vec_id, high, low, w): the deviation high * 10^18 + low, and the whitened row."""
    dims, count = weights.shape

    def run(batches):
        for batch in batches:
            at, x = _integers(batch.column("_vec"), dims, scale, offset)
            gap = _scaled_gap(x, n, sums)
            exact = _deviations(gap)
            w = (gap / n).astype(np.float64) @ weights
            offsets = np.arange(0, w.size + 1, count, dtype=np.int32)
            arrays = [batch.column("_id").take(pa.array(at)), *(pa.array([Decimal(f(v)) for v in exact], pa.decimal128(38, 0)) for f in (lambda v: v // _LIMB, lambda v: v % _LIMB))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, w.ravel())], ["vec_id", "high", "low", "w"])

    return rows.mapInArrow(run, "vec_id long, high decimal(38,0), low decimal(38,0), w array<double>")


def _identity_error(projected: DataFrame, count: int) -> float:
    """Largest entry of the projected rows' covariance minus the identity, centred before multiplying."""
    w = [F.col("w")[i] for i in range(count)]
    mean = projected.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first()
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    centred = projected.select(*((c - F.lit(mean[i])).alias(f"c{i}") for i, c in enumerate(w)))
    found = centred.agg(*(F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"v{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[p] - float(i == j)) for p, (i, j) in enumerate(pairs))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Per vector kept and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vec"))
    n, sums = _sums(rows, scale, offset)
    values, axes = _components(rows, n, sums, components, scale, offset) if n else (np.zeros(0), np.zeros((0, 0)))
    if not len(values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    projected = staged(_project(rows, n, sums, axes / np.sqrt(values), scale, offset), "whitening-rows")
    total = projected.agg(F.sum("high").alias("high"), F.sum("low").alias("low")).first()
    variance = (int(total.high) * _LIMB + int(total.low)) / n**3
    share = F.array(*(F.lit(float(e / variance)) for e in values))
    exact = (F.col("high") * F.lit(Decimal(_LIMB)) + F.col("low")).cast("decimal(38,0)")
    out = projected.withColumn("identity_error", F.lit(_identity_error(projected, len(values)))).withColumn("deviation_exact", exact)
    out = out.select("vec_id", F.posexplode("w").alias("at", "whitened"), "identity_error", "deviation_exact")
    fits = F.when(F.col("deviation_exact") <= F.lit(Decimal((1 << 63) - 1)), F.col("deviation_exact").cast("long"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), fits.alias("deviation"), "whitened", share[F.col("at")].alias("explained"), "identity_error", "deviation_exact")
