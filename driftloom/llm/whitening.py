"""Whitening of vectors by shifted CholeskyQR.

The fit list holds every distinct vector once.  A pass multiplies the transposed rows with the
rows, task by task, and adds the small products up.  The first pass factors the product of the
centred rows plus a shift, which is safe for any condition number; every further pass solves the
rows through the triangular factors found so far, factors what is left, and so makes the rows
more orthogonal.  The factors compose to one R with the rows equal to orthogonal rows times R.
The singular values and right singular vectors of R, with the symmetric root of the last product
applied, give the variances and components: the squared condition number of a covariance never
enters, and dimensions that do not vary need no care.

Tasks hold one batch and one small product.  Equal vectors, however many, meet as partial
aggregates.  Everything the driver sees has the size of a product.

Defined cases: vectors that are null, or hold a null or non-finite entry, take no part; a shorter
vector counts as if zeros followed; entries beyond a long are held at its ends, and so are
deviations; components without variance (below ``RANK`` of the largest deviation) are not
returned, so equal vectors, a single one and an empty table give no rows; repeated rows and ids
are rows of their own; a null id stays null; extra columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import added, query, table, written

SCALE, COMPONENTS = 256.0, 4
#: Most passes that orthogonalise, and the largest difference of a product from one that ends them.
PASSES, ENOUGH = 6, 1e-13
#: Smallest singular value, as a share of the largest, that counts as variance.
RANK = 1e-11
LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: float = SCALE) -> tuple[DataFrame, int]:
    """Written ``key`` and ``x`` (entries as longs ``floor(scale * c)``, zeros behind shorter vectors), and their width."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & finite)
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(scale) * c.cast("double")))
    x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))
    return written(rows.select(F.col(key).alias("key"), x.alias("x"))), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Fit:
    """Number, sums and triangular factors of a fit list, and what follows from them."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray | None = None
    variances: np.ndarray | None = None
    total: float = 0.0
    identity_error: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Exact ``n * x - sums``: longs where they fit, Python integers elsewhere."""
        if max(self.n * float(np.abs(x.astype(float)).max(initial=0)), float(max(map(abs, self.sums)))) < 2.0**61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean: one rounding after the exact difference."""
        return (self.scaled(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        y = self.scaled(x)
        if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 2.0**62:
            return (y * y).sum(1)
        return np.array([min(sum(int(v) ** 2 for v in row), LONG) for row in y], np.int64)

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        """Centred rows, solved through the factors one after the other."""
        rows = self.centred(x)
        for r in self.factors:
            rows = np.linalg.solve(r.T, rows.T).T
        return rows

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def _product(rows: DataFrame, width: int, of) -> np.ndarray:  # noqa: ANN001
    """``of(x)`` transposed times itself over all rows, as sums of the tasks' products."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                q = of(_matrix(batch.column(0), width))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "data"])

    found = added(rows.select("x").mapInArrow(task, "slot int, data binary"), 1)[0]
    size = int(np.sqrt(len(found)))
    return found.reshape(size, size)


def _triangular(product: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper R with ``R.T @ R`` equal to the product, plus a shift where asked for or needed."""
    d, size = len(product), float(np.trace(product))
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * size
    while True:
        try:
            return np.linalg.cholesky(product + (shift if shifted else 0.0) * np.eye(d)).T
        except np.linalg.LinAlgError:  # a product of deficient rows; a larger shift always ends
            shift, shifted = max(shift, np.finfo(float).eps * size) * (10 if shifted else 1), True


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Fit | None:
    """Fit over the rows of ``distinct`` (written, ``x``); none where nothing varies."""
    values = distinct.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    n = distinct.count()
    if not n or not width:
        return None
    sums = {r.d: int(r.s) for r in values.collect()}
    model = Fit(n, [sums[d] for d in range(width)])
    product = _product(distinct, width, model.centred)
    model.total = float(np.trace(product))
    if not model.total > 0:
        return None
    for done in range(PASSES):
        model.factors.append(_triangular(product, n, done == 0))
        product = _product(distinct, width, model.orthogonal)
        if np.abs(product - np.eye(width)).max() < ENOUGH * width:
            break
    r = np.eye(width)
    for factor in model.factors:
        r = factor @ r
    size, vectors = np.linalg.eigh(product)
    root = vectors * np.sqrt(np.maximum(size, 0)) @ vectors.T
    _, deviations, right = np.linalg.svd(root @ r)
    k = min(components, int((deviations > RANK * deviations[0]).sum()))
    sign = np.sign(right[np.arange(k), np.abs(right[:k]).argmax(1)])
    model.components, model.variances = (right[:k] * sign[:, None]).T, deviations[:k] ** 2 / n
    model.total = float((deviations**2).sum() / n)
    again = _product(distinct, width, lambda x: np.hstack([model.whitened(x), np.ones((len(x), 1))])) / n
    covariance = again[:-1, :-1] - np.outer(again[-1, :-1], again[-1, :-1])
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of every row and component."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows, width = whole_numbers(vectors, key, vector, scale)
    model = fit(written(rows.select("x").distinct()), width, components)
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    explained, k = model.variances / model.total, len(model.variances)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column(1), width), batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(np.repeat(model.deviation(x), k)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("key", "x").mapInArrow(task, schema).withColumnRenamed("key", key)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
