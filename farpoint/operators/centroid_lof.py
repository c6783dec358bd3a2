"""Local outlier factor of rows against cluster centres."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farpoint.functions import vectors

SCORES = T.StructType(
    [
        T.StructField("kdist", T.DoubleType()),
        T.StructField("neighbours", T.ArrayType(T.IntegerType())),
        T.StructField("lrd", T.DoubleType()),
        T.StructField("lof", T.DoubleType()),
    ]
)


def k_nearest(distances: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest per row, by distance, then index."""
    return np.argsort(distances, axis=1, kind="stable")[:, :k]


@dataclass(frozen=True)
class CentroidLof:
    """k-distance and reachability density of every centre, worked out once.

    A row's factor then needs only its own distances to the centres.  With ``sizes`` the
    neighbours' densities are weighted by cluster size.
    """

    centers: np.ndarray
    min_pts: int
    kdist: np.ndarray
    lrd: np.ndarray
    sizes: np.ndarray | None = None

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``kdist``, ``neighbours``, ``lrd`` and ``lof``; no shuffle."""
        centers, k, kdist, lrd, sizes = self.centers, self.min_pts, self.kdist, self.lrd, self.sizes

        @F.arrow_udf(SCORES)
        def factors(column: pa.Array) -> pa.Array:
            d = np.sqrt(vectors.pairwise_squared(vectors.to_matrix(column, centers.shape[1]), centers))
            near = k_nearest(d, k)
            near_d = np.take_along_axis(d, near, axis=1)
            own = _density(near_d, kdist[near])
            factor = _factor(lrd[near], own, None if sizes is None else sizes[near])
            return pa.StructArray.from_arrays(
                [
                    pa.array(near_d[:, -1] if len(d) else np.empty(0)),
                    vectors.to_lists(near.astype(np.int32)),
                    pa.array(own),
                    pa.array(factor),
                ],
                fields=[pa.field(f.name, t) for f, t in zip(SCORES.fields, _ARROW)],
            )

        scored = df.withColumn("_s", vectors.once(factors, F.col(features)))
        return scored.withColumns({f.name: F.col(f"_s.{f.name}") for f in SCORES.fields}).drop("_s")


_ARROW = (pa.float64(), pa.list_(pa.int32()), pa.float64(), pa.float64())


def _density(near_distances: np.ndarray, near_kdist: np.ndarray) -> np.ndarray:
    reach = np.maximum(near_distances, near_kdist)
    with np.errstate(divide="ignore"):
        return reach.shape[1] / reach.sum(axis=1)


def _factor(neighbour_lrd: np.ndarray, own: np.ndarray, sizes: np.ndarray | None) -> np.ndarray:
    k = neighbour_lrd.shape[1]
    ratios = neighbour_lrd / own[:, None]
    if sizes is None:
        return ratios.sum(axis=1) / k
    share = sizes / sizes.sum(axis=1, keepdims=True)
    return (share * ratios).sum(axis=1) / k


def fit(
    centers: np.ndarray, min_pts: int, sizes: np.ndarray | None = None, self_inclusive: bool = True
) -> CentroidLof:
    """Densities on the k x k centre table.

    ``self_inclusive`` lets a centre count itself, at distance 0, among its own nearest
    centres; otherwise only the others count.
    """
    centers = np.asarray(centers, dtype=float)
    k = min(min_pts, len(centers) if self_inclusive else len(centers) - 1)
    if k < 1:
        raise ValueError("too few centres for a neighbourhood")
    d = np.sqrt(vectors.pairwise_squared(centers, centers))
    if not self_inclusive:
        np.fill_diagonal(d, np.inf)
    near = k_nearest(d, k)
    near_d = np.take_along_axis(d, near, axis=1)
    kdist = near_d[:, -1]
    lrd = _density(near_d, kdist[near])
    return CentroidLof(centers, k, kdist, lrd, None if sizes is None else np.asarray(sizes, dtype=float))


def sizes_vector(sizes: DataFrame, k: int, cluster: str = "cluster") -> np.ndarray:
    """Cluster sizes as a vector, 0 for an empty cluster."""
    out = np.zeros(k)
    for row in sizes.collect():
        out[row[cluster]] = row["n"]
    return out
