"""Principal components with a fixed sign, fitted by Spark ML."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.functions import vectors
from farpoint.operators.kmeans import sum_arrays
from farpoint.operators.scale import fit_vectors
from farpoint.session import materialize

#: Features whose lines of the product travel in one row.
_LINES = 1024


@dataclass(frozen=True)
class Components:
    """``matrix`` is d x k; ``mean`` is set when projection centres first."""

    matrix: np.ndarray
    variance_share: np.ndarray
    mean: np.ndarray | None = None

    def project(self, df: DataFrame, features: str = "features", output: str | None = None) -> DataFrame:
        return df.withColumn(output or features, vectors.affine(F.col(features), self.matrix, self.mean))

    def after(self, shift: np.ndarray, divisor: np.ndarray) -> Components:
        """The same projection of ``(x - shift) / divisor``, as one product per row."""
        center = shift if self.mean is None else shift + self.mean * divisor
        return Components(self.matrix / divisor[:, None], self.variance_share, center)

    def table(self, spark) -> DataFrame:
        """``(feature, component, weight)``."""
        rows = [
            (int(i), int(j), float(self.matrix[i, j]))
            for i in range(self.matrix.shape[0])
            for j in range(self.matrix.shape[1])
        ]
        return spark.createDataFrame(rows, "feature int, component int, weight double")


def fix_signs(matrix: np.ndarray) -> np.ndarray:
    """Flip columns so that the entry of largest size is positive."""
    largest = np.abs(matrix).argmax(axis=0)
    signs = np.sign(matrix[largest, np.arange(matrix.shape[1])])
    return matrix * np.where(signs == 0, 1.0, signs)


def fit_components(
    df: DataFrame, k: int | None = None, features: str = "features", centered: bool = False
) -> Components:
    """Top-k components of the covariance matrix; all of them when k is None.

    The distributed step is one d x d aggregate, so the driver's share depends on the
    number of features only.  ``centered`` subtracts the mean before projecting; the
    default projects raw rows.
    """
    if k is None:
        k = df.select(F.size(features).alias("d")).first().d
    vector = df.select(array_to_vector(F.col(features)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vector)
    mean = fit_vectors(df, features, with_std=False).mean if centered else None
    return Components(fix_signs(model.pc.toArray()), model.explainedVariance.toArray(), mean)


def fit_wide_components(
    df: DataFrame,
    k: int,
    features: str = "features",
    centered: bool = False,
    spare: int = 8,
    passes: int = 30,
    tol: float = 1e-7,
    seed: int = 5,
) -> Components:
    """Top-k components without the d x d covariance, by subspace iteration from a random start.

    A pass multiplies the covariance by ``k + spare`` directions: a task sums ``x (x'Q)`` over its
    centred rows, so that no machine holds more than d x (k + spare) numbers.  The passes end once
    the sine of the largest angle between the leading k directions of two of them is under
    ``tol``, or with a warning after ``passes``; how fast they come to rest depends on how far the k-th variance
    exceeds that of the first direction left out, and equal variances have no directions of their own.
    """
    mean = fit_vectors(df, features, with_std=False).mean
    d, rows = len(mean), materialize(df.select(features), "wide-rows")
    if not 1 <= k <= d:
        raise ValueError(f"1 to {d} components")
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, k + spare))))[0]
    before = None
    for _ in range(passes):
        n, total, product = _covariance_times(rows, q, mean)
        if n < 2:
            raise ValueError("two rows at least")
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        values, lead = values[::-1], (q @ turn)[:, ::-1]
        if before is not None and np.linalg.norm(lead[:, :k] - before @ (before.T @ lead[:, :k]), 2) < tol:
            break
        before, q = lead[:, :k], np.linalg.qr(product)[0]
    else:
        warnings.warn(f"components still turn after {passes} passes; give more passes or more spare directions", stacklevel=2)
    share = np.maximum(values[:k], 0.0) / total if total > 0 else np.zeros(k)
    return Components(fix_signs(lead[:, :k]), share, mean if centered else None)


def _covariance_times(rows: DataFrame, q: np.ndarray, mean: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Number of rows, sum of all variances, and the sample covariance times ``q``."""
    d, width = q.shape
    starts = list(range(0, d, _LINES))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, product = 0, 0.0, np.zeros((d, width))
        for batch in batches:
            x = vectors.to_matrix(batch.column(0), d) - mean
            n += len(x)
            squares += float((x * x).sum())
            product += x.T @ (x @ q)
        if n:
            lists = pa.array([product[s : s + _LINES].ravel() for s in starts], pa.list_(pa.float64()))
            once = [1] + [0] * (len(starts) - 1)
            counts = pa.array([n * o for o in once], pa.int64()), pa.array([squares * o for o in once], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(starts, pa.int32()), *counts, lists], names=["start", "n", "squares", "product"]
            )

    parts = rows.mapInArrow(partial, "start int, n long, squares double, product array<double>")
    sums = parts.groupBy("start").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), sum_arrays(F.col("product")).alias("product"))
    n, squares, product = 0, 0.0, np.zeros((d, width))
    for row in sums.collect():  # d x width numbers in all
        n, squares = n + row.n, squares + row.squares
        product[row.start : row.start + _LINES] = np.reshape(row.product, (-1, width))
    return n, squares / max(1, n - 1), product / max(1, n - 1)
