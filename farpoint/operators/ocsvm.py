"""One-class SVM: scoring by support vectors, and a distributed linear fit on
random Fourier features of the RBF kernel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farpoint.functions import vectors
from farpoint.operators import kmeans
from farpoint.operators.kmeans import sum_arrays
from farpoint.operators.scale import VectorScaler, fit_vectors
from farpoint.operators.threshold import order_statistic
from farpoint.session import materialize

_MODEL_BYTES = 64 * 1024 * 1024
_CHUNK_ROWS = 200_000
#: Landmarks at most; their kernel matrix is solved on the driver.
MAX_LANDMARKS = 1024


def score_support_vectors(
    df: DataFrame,
    support: DataFrame,
    gamma: float = -1.0,
    rho: float = 0.0,
    features: str = "features",
    model_bytes: int = _MODEL_BYTES,
) -> DataFrame:
    """Add ``score = sum alpha * exp(gamma |x - sv|^2) - rho`` and ``accepted = score > 0``.

    ``support`` has ``center`` and optionally ``alpha``.  A support table under
    ``model_bytes`` goes along with the tasks; a larger one is cut into blocks, every
    row meets every block, and the partial sums are added per row.  Rows are numbered for
    that in a stored table, so keys may be repeated, null or absent in either case.
    """
    if "alpha" not in support.columns:
        support = support.withColumn("alpha", F.lit(1.0))
    size = support.agg(F.count("*").alias("n"), F.max(F.size("center")).alias("d")).first()
    if not size.n:
        raise ValueError("no support vectors")
    if size.n * (size.d + 1) * 8 <= model_bytes:
        rows = support.select("center", "alpha").collect()
        matrix = np.array([r.center for r in rows], dtype=float)
        alpha = np.array([r.alpha for r in rows], dtype=float)
        total = df.withColumn("score", vectors.kernel_sum(F.col(features), matrix, alpha, gamma) - F.lit(float(rho)))
    else:
        row, part = (_free_name(df, c) for c in ("_row", "_sum"))
        numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
        sums = _blocked_sums(numbered, support, gamma, features, row, size, model_bytes).withColumnRenamed("sum", part)
        total = numbered.join(sums, row).withColumn("score", F.col(part) - F.lit(float(rho))).drop(row, part)
    return total.withColumn("accepted", F.col("score") > 0)


def _free_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _blocked_sums(df, support, gamma, features, key, size, model_bytes) -> DataFrame:
    """``(key, sum)`` of rows whose ``key`` is unique and not null."""
    blocks = -(-size.n // max(1, model_bytes // ((size.d + 1) * 8)))
    chunks = -(-df.count() // _CHUNK_ROWS)
    block = F.pmod(F.xxhash64("center"), F.lit(blocks)).cast("int")
    held = support.select("center", "alpha", block.alias("block"))
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rows = df.select(F.col(key).alias("key"), F.col(features).alias("x"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": left["key"].slice(0, 0), "part": np.empty(0)})
        x, centers, alpha = vectors.to_matrix(left["x"]), vectors.to_matrix(right["center"]), right["alpha"].to_numpy()
        part = np.zeros(len(x))
        for center, weight in zip(centers, alpha):
            part += weight * np.exp(gamma * ((x - center) ** 2).sum(axis=1))
        return pa.table({"key": left["key"], "part": part})

    schema = T.StructType([rows.schema["key"], T.StructField("part", T.DoubleType())])
    parts = rows.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInArrow(partial, schema)
    return parts.groupBy(F.col("key").alias(key)).agg(F.sum("part").alias("sum"))


@dataclass(frozen=True)
class OneClassSvm:
    """Score ``w . z(x) - rho`` with ``z`` the random Fourier map; accepted when >= 0."""

    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float
    scaler: VectorScaler | None = None

    def score(self, df: DataFrame, features: str = "features", output: str = "score") -> DataFrame:
        directions, phases, weights, rho, scaler = (
            self.directions,
            self.phases,
            self.weights,
            self.rho,
            self.scaler,
        )

        @F.arrow_udf(T.DoubleType())
        def margin(column: pa.Array) -> pa.Array:
            found = [np.empty(0)]
            for x in vectors.slices(column, directions.shape[0]):
                if scaler is not None:
                    x = (x - scaler.mean) / scaler.divisor
                found.append(_fourier(x, directions, phases) @ weights)
            return pa.array(np.concatenate(found) - rho)

        return df.withColumn(output, vectors.once(margin, F.col(features))).withColumn("accepted", F.col(output) >= 0)


def _fourier(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    turns = x @ (directions / (2.0 * np.pi))
    turns += phases / (2.0 * np.pi)
    z = vectors.cosines(turns)
    z *= np.sqrt(2.0 / len(phases))
    return z


def train(
    df: DataFrame,
    nu: float = 0.1,
    gamma: float | None = None,
    scale: bool = True,
    components: int = 256,
    steps: int = 30,
    seed: int = 7,
    features: str = "features",
) -> OneClassSvm:
    """Full-batch sub-gradient descent on the one-class objective.

    The objective is ``|w|^2/2 - rho + mean(max(0, rho - w.z)) / nu``.  The rows are scaled and
    packed into blocks once.  A step is one aggregate over the blocks that brings back the vector
    sum of the violating rows; after the last one ``rho`` becomes the exact nu-quantile of the
    training scores, so that a share nu of the rows is rejected.  ``gamma`` defaults to 1/d.
    """
    scaler = fit_vectors(df, features, sample=True) if scale else None
    prepare = None if scaler is None else lambda x: (x - scaler.mean) / scaler.divisor
    blocks = vectors.packed(df, features, prepare=prepare).persist()
    try:
        n, d = vectors.packed_size(blocks)
        width = gamma if gamma is not None else 1.0 / d
        random = np.random.default_rng(seed)
        directions = random.normal(scale=np.sqrt(2.0 * width), size=(d, components))
        phases = random.uniform(0.0, 2.0 * np.pi, size=components)
        mean = _violators(blocks, directions, phases, np.zeros(components), np.inf)[1] / n
        w, rho = mean, float(mean @ mean)
        total_w = np.zeros(components)
        for step in range(1, steps + 1):
            count, total = _violators(blocks, directions, phases, w, rho)
            rate = 1.0 / (step + 1)
            w = w - rate * (w - total / (nu * n))
            rho = rho - rate * (count / (nu * n) - 1.0) * max(abs(rho), 1e-3)
            total_w += w
        w = total_w / steps
        rho = order_statistic(_scores(blocks, directions, phases, w), "score", max(1, int(n * nu) + 1))
        return OneClassSvm(directions, phases, w, rho, scaler)
    finally:
        blocks.unpersist()


def _violators(blocks, directions, phases, w, rho) -> tuple[int, np.ndarray]:
    """Number and Fourier sum of the packed rows that score under ``rho``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(phases))
        for batch in batches:
            for x in vectors.slices(batch.column(0), directions.shape[0]):
                z = _fourier(x, directions, phases)
                under = z @ w < rho
                n += int(under.sum())
                total += under.astype(float) @ z
        yield pa.RecordBatch.from_arrays([pa.array([n]), vectors.to_lists(total[None, :])], names=["n", "total"])

    row = (
        blocks.select("x").mapInArrow(partial, "n long, total array<double>")
        .agg(F.sum("n").alias("n"), sum_arrays(F.col("total")).alias("total"))
        .first()
    )
    return row.n, np.array(row.total)


def _scores(blocks, directions, phases, w) -> DataFrame:
    """``score`` of every packed row, before ``rho`` is taken off."""

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(batch.num_rows):
                rows = vectors.slices(batch.column(0).slice(block, 1), directions.shape[0])
                found = [_fourier(x, directions, phases) @ w for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["score"])

    return blocks.select("x").mapInArrow(margins, "score double")


# --- landmarks ---------------------------------------------------------------


@dataclass(frozen=True)
class LandmarkSvm:
    """Support vectors among landmarks, in scaled space: ``sum alpha * exp(-gamma |x - center|^2) - rho``."""

    centers: np.ndarray
    alpha: np.ndarray
    rho: float
    gamma: float
    scaler: VectorScaler | None = None

    def support(self, spark: SparkSession) -> DataFrame:
        """``(center, alpha)`` as :func:`score_support_vectors` reads it, with ``-gamma`` and ``rho``."""
        rows = [([float(v) for v in c], float(a)) for c, a in zip(self.centers, self.alpha)]
        return spark.createDataFrame(rows, "center array<double>, alpha double")

    def scaled(self, features: str = "features"):
        """The column that the support vectors are compared with."""
        x = F.col(features)
        return x if self.scaler is None else vectors.shift_and_divide(x, self.scaler.mean, self.scaler.divisor)

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        at = _free_name(df, "_scaled")
        rows = df.withColumn(at, self.scaled(features))
        return score_support_vectors(rows, self.support(df.sparkSession), -self.gamma, self.rho, at).drop(at)


def train_landmarks(
    df: DataFrame,
    nu: float = 0.1,
    gamma: float | None = None,
    scale: bool = True,
    landmarks: int = 256,
    iterations: int = 5,
    key: str = "id",
    seed: int = 7,
    features: str = "features",
) -> LandmarkSvm:
    """One-class SVM whose support vectors are k-means centres, each as heavy as the rows nearest to it.

    Every row weighs in, so a region with few rows has its landmark or its share of one.  The dual,
    ``min a'Ka / 2`` with ``0 <= a_i <= share_i / nu`` and sum 1, has one unknown a landmark.  ``rho``
    lies halfway between the training scores on either side of the exact nu-quantile, so that
    ``floor(nu * n)`` rows are rejected where no scores tie there.  The rows are scanned once a
    round of k-means, once for the shares and once for the scores; their number grows no further.
    With fewer different rows than landmarks, each is one.
    """
    if not 1 <= landmarks <= MAX_LANDMARKS:
        raise ValueError(f"1 to {MAX_LANDMARKS} landmarks")
    if not 0 < nu <= 1:
        raise ValueError("nu is a share of the rows")
    scaler = fit_vectors(df, features, sample=True) if scale else None
    model = LandmarkSvm(np.empty((0, 0)), np.empty(0), 0.0, 1.0, scaler)
    rows = materialize(df.select(key, model.scaled(features).alias("x")), "landmark-rows")
    n = rows.count()
    if not n:
        raise ValueError("no rows")
    seeds = kmeans.parallel_seeds(rows, [min(landmarks, n)], [key], seed, features="x")[0]
    found = kmeans.lloyd(rows, seeds, iterations, "x")
    sizes = kmeans.cluster_sizes(found.assign(rows, "x")).collect()  # one row a landmark
    used = np.array([r.cluster for r in sizes])
    centers, share = found.matrix[used], np.array([r.n for r in sizes]) / n
    width = gamma if gamma is not None else 1.0 / centers.shape[1]
    alpha = _solve(np.exp(-width * vectors.pairwise_squared(centers, centers)), share / nu)
    kept = alpha > 0
    model = LandmarkSvm(centers[kept], alpha[kept], 0.0, width, scaler)
    scores = score_support_vectors(rows.select("x"), model.support(df.sparkSession), -width, 0.0, "x").select("score")
    scores = materialize(scores, "landmark-scores")
    rejected = int(n * nu)
    above = order_statistic(scores, "score", min(n, rejected + 1))
    below = order_statistic(scores, "score", rejected) if rejected else above - 1e-6 * max(1.0, abs(above))
    return LandmarkSvm(centers[kept], alpha[kept], (above + below) / 2, width, scaler)


def _solve(kernel: np.ndarray, cap: np.ndarray, gap: float = 1e-9, steps: int = 200_000) -> np.ndarray:
    """Least ``a'Ka / 2`` under ``0 <= a <= cap`` and sum 1: mass moves between the two that violate most."""
    alpha = np.minimum(cap, np.maximum(0.0, 1.0 - np.concatenate([[0.0], np.cumsum(cap)[:-1]])))
    slope = kernel @ alpha
    for _ in range(steps):
        up = int(np.where(alpha < cap, slope, np.inf).argmin())
        down = int(np.where(alpha > 0, slope, -np.inf).argmax())
        if not slope[down] - slope[up] > gap:
            break
        curve = kernel[up, up] + kernel[down, down] - 2 * kernel[up, down]
        free = min(cap[up] - alpha[up], alpha[down])
        move = free if curve <= 0 else min((slope[down] - slope[up]) / curve, free)
        alpha[up] = cap[up] if move == cap[up] - alpha[up] else alpha[up] + move
        alpha[down] = 0.0 if move == alpha[down] else alpha[down] - move
        slope += move * (kernel[:, up] - kernel[:, down])
    return alpha
