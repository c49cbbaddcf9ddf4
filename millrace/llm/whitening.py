"""Whitening of embedding vectors by the singular values of their centred, distributed rows.

Entries are put on a grid of whole numbers, x = floor(scale * c) + shift, so that sums, the mean's numerator and every row's squared
deviation are exact. The fit list holds each distinct x vector once. Its rows, centred as (n * x - S) / n with the difference exact, become
a RowMatrix, and computeSVD gives the right singular vectors, which are the unit eigenvectors of the covariance V. Spark's
singular values s belong to the sum of squares, so with the divisor n the eigenvalue is e = s * s / n. The trace of V does not come from them: it
is the sum of the rows' exact deviations over n * n * n.

What reaches the driver grows with the dimensions only: S, the Gramian that computeSVD decomposes, and the sums of products of the whitened
components. All singular vectors are asked for, as Spark then decomposes the Gramian by LAPACK; for a few of many it would stop an
iteration at a tolerance of 1e-10.

Defined cases: a row whose vector is null, or has a null, a NaN or an infinite entry, is left out, and so is one with an
entry beyond +-LARGEST, which has no exact place on the grid. All vectors have one length, that of most of those rows (of lengths that tie, the larger); rows of other
lengths are left out. Rows that repeat an id or a vector each get their results; a vector counts once in the fit. Null ids are ids like others. Of
eigenvalues that tie, any basis of their space is right, and it is the same one for all rows. A component whose eigenvalue is under FLAT of the
largest has no direction that doubles can tell, and is not returned: a single distinct vector, or an empty table, gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import tidy, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries up to this lie on the grid exactly
LARGEST = float(1 << 40)
#: Share of the largest eigenvalue under which a component is noise
FLAT = 1e-12


def grid(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, an array of longs, of the rows that count."""
    c = F.col(vector_col)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) > F.lit(LARGEST)))
    x = F.transform(c, lambda v: (F.floor(F.lit(float(scale)) * v.cast("double")) + F.lit(shift)).cast("long"))
    rows = vectors.where(c.isNotNull() & (F.size(c) > 0) & ~bad).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (sizes.d if sizes else 0))


def _sums(batches):
    """The sum of each dimension of a task's rows, as whole numbers of any size."""
    total = None
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            part = x.sum(axis=0) if abs(x).max() < (1 << 62) // b.num_rows else x.astype(object).sum(axis=0)
            total = part.astype(object) if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "total"])


def _offsets(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they are wide enough, else in Python's integers."""
    reach = max(int(abs(x).max()) if x.size else 0, 1) * n + max(map(abs, total))
    if reach < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _deviation(offsets: np.ndarray) -> list[int]:
    if offsets.dtype != object and offsets.size and float(abs(offsets).max()) ** 2 * offsets.shape[1] < 1 << 62:
        return (offsets * offsets).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in offsets.tolist()]


class Whitening:
    """A fitted transform: n, the sums S, components as columns, their eigenvalues and the trace of V."""

    def __init__(self, n: int, total: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.total, self.components, self.values, self.trace = n, total, components, values, trace

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The whitened components of rows, and their exact deviations."""
        offsets = _offsets(x, self.n, self.total)
        centred = (offsets / self.n).astype(np.float64)
        return centred @ self.components / np.sqrt(self.values), _deviation(offsets)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def fit(points: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The transform of a fit list, a written table with a column x of distinct arrays of longs; None if it has no direction."""
    sums = points.select("x").mapInArrow(tidy(_sums), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).orderBy("i").collect()
    n = points.count()
    if n < 2:
        return None
    total = [int(r.total) for r in sums]

    def deviations(batches):
        for b in batches:
            if b.num_rows:
                own = _deviation(_offsets(_matrix(b.column(0), b.num_rows), n, total))
                yield pa.RecordBatch.from_arrays([pa.array([Decimal(sum(own))], pa.decimal128(38, 0))], ["d"])

    spread = points.select("x").mapInArrow(tidy(deviations), "d decimal(38,0)").agg(F.sum("d")).first()[0]
    if not spread:
        return None
    means = F.array(*[F.lit(t).cast("decimal(38,0)") for t in total]) if max(map(abs, total)) >= 1 << 62 else F.array(*[F.lit(t).cast("long") for t in total])
    wide: Column = F.lit(n).cast("decimal(20,0)" if max(map(abs, total)) >= 1 << 62 else "long")
    centred = F.zip_with("x", means, lambda v, s: (v * wide - s).cast("double") / F.lit(float(n)))
    rows = MLUtils.convertVectorColumnsFromML(points.select(array_to_vector(centred).alias("v")), "v")
    svd = RowMatrix(rows, n, len(total)).computeSVD(len(total), computeU=False, rCond=FLAT**0.5)
    values = np.asarray(svd.s.toArray()) ** 2 / n
    k = min(components, len(values))
    return Whitening(n, total, np.asarray(svd.V.toArray())[:, :k], values[:k], float(Decimal(spread) / Decimal(n) ** 3))


def identity_error(points: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity; divisor n, rows centred before they are multiplied."""
    k = len(model.values)

    def products(batches):
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w, _ = model.project(_matrix(b.column(0), b.num_rows))
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["i", "total"])

    cells = points.select("x").mapInArrow(tidy(products), "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    found = np.zeros(k * k)
    for r in cells:
        found[r.i] = r.total
    return float(abs(found.reshape(k, k) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each row that counts and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = written(grid(vectors, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift), "grid")
    points = written(rows.select("x").distinct(), "points")
    model = fit(points, components=components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, error, share = len(model.values), identity_error(points, model), model.values / model.trace

    def run(batches):
        for b in batches:
            w, own = model.project(_matrix(b.column(1), b.num_rows)) if b.num_rows else (np.zeros((0, k)), [])
            each = np.repeat(np.arange(b.num_rows), k)
            far = pa.array([Decimal(d) for d in own], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(each), model.n)), far.take(pa.array(each)),
                    pa.array(w.ravel()), pa.array(np.tile(share, b.num_rows)), pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(tidy(run), schema)
