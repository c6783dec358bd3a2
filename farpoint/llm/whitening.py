"""Embedding whitening over an exact covariance, by polarisation.

Entries become whole numbers, so nothing is rounded before the covariance is known.  One pass
adds up counts and sums; the next adds the squares of centred values, for every dimension and for
the sum of every two dimensions.  Half of what the variance of a sum exceeds the two variances is
the covariance of the two:  2 cov(a, b) = var(a + b) - var(a) - var(b).  All of it is integer
arithmetic; the matrix is rounded once, entry by entry, and handed to ``eigh``.

Values are centred on the floor of their mean, which is whole; what the mean lies above that,
less than one unit, is taken off the finished sums exactly:  with x' = x - m and r = S - n m,
the sum of (n x - S)^2 is n^2 sum(x'^2) - n r^2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Widest vectors taken: the driver holds the matrix of d x d doubles and its sums.
MAX_DIMENSIONS = 4096
#: Whole numbers beyond this leave the fast path of 64-bit sums and are added as Python integers.
_FAST = 1 << 20
_ROWS = 4096
#: Sums travel as digits of this base, which Spark adds without rounding or overflow.
_BASE = 1 << 32


def usable(vector: str) -> Column:
    """True for a vector that holds entries, none of them null, NaN or infinite."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def _whole(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    """Matrix of whole numbers: int64, or Python integers where these do not fit."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    # SCALE is a power of two, so the product is exact
    if not flat.size or np.abs(flat).max() < 2.0**40:
        return np.floor(flat * SCALE).astype(np.int64) + SHIFT
    exact = [[int(c) * SCALE if abs(c) >= 2.0**53 else math.floor(c * SCALE) for c in row] for row in flat.tolist()]
    return np.array(exact, object) + SHIFT


def _centred(batch: pa.RecordBatch, column: int, centre: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask of the rows whose distance from ``centre`` is at most ``_FAST``, these as int64, the others as Python integers."""
    x = _whole(batch, column, len(centre))
    small = x.dtype != object and max(map(abs, centre), default=0) < 1 << 62
    x = x - np.array(centre, np.int64 if small else object)
    near = (np.abs(x) <= _FAST).all(axis=1).astype(bool)
    return near, x[near].astype(np.int64), x[~near].astype(object)


def _partial(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Rows ``(i, j, limb, value)``: the sums in base ``_BASE``, each digit with the sign of the whole."""
    rows = []
    for (i, j), total in sums.items():
        rest, limb, sign = abs(total), 0, -1 if total < 0 else 1
        while rest:
            rest, digit = divmod(rest, _BASE)
            rows.append((i, j, limb, sign * digit))
            limb += 1
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "j", "limb", "value"])


_SUMS = "i int, j int, limb int, value long"


def _added(partial: DataFrame) -> dict[tuple[int, int], int]:
    """The exact sums by ``(i, j)``, added in Spark; one row a pair and digit goes to the driver."""
    found: dict[tuple[int, int], int] = {}
    for i, j, limb, value in partial.groupBy("i", "j", "limb").agg(F.sum("value")).collect():
        found[i, j] = found.get((i, j), 0) + value * _BASE**limb
    return found


def column_sums(rows: DataFrame, vector: str, width: int) -> list[int]:
    """Exact sums of the whole numbers of every dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = _whole(batch.slice(at, _ROWS), 0, width)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield _partial({(i, i): s for i, s in enumerate(total)})

    found = _added(rows.select(vector).mapInArrow(summed, _SUMS))
    return [found.get((i, i), 0) for i in range(width)]


def pair_squares(x: np.ndarray) -> np.ndarray:
    """``q[i, j]``: sum of (x_i + x_j)^2 over the rows, for i < j; ``q[i, i]``: sum of x_i^2."""
    width = x.shape[1]
    out = np.zeros((width, width), x.dtype)
    for i in range(width):
        sums = x[:, i:] + x[:, i : i + 1]
        sums[:, 0] = x[:, i]
        out[i, i:] = np.einsum("ij,ij->j", sums, sums) if x.dtype != object else (sums * sums).sum(axis=0)
    return out


def centred_squares(rows: DataFrame, vector: str, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of squares of centred values: ``(i, i)`` of a dimension, ``(i, j)`` of the sum of two."""
    width = len(centre)
    pairs = np.triu_indices(width)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pairs[0]), object)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                # _ROWS squares of at most (2 * _FAST)^2 stay below 2^63
                _, near, far = _centred(batch.slice(at, _ROWS), 0, centre)
                total += pair_squares(near)[pairs].astype(object)
                if len(far):
                    total += pair_squares(far)[pairs]
        yield _partial(dict(zip(zip(*(p.tolist() for p in pairs)), total.tolist())))

    found = _added(rows.select(vector).mapInArrow(summed, _SUMS))
    return {(i, j): found.get((i, j), 0) for i, j in zip(*(p.tolist() for p in pairs))}


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors, their exact sums, covariance, and components as columns by falling eigenvalue.

    The covariance and the eigenvalues are in units of 4^``shift``, zero unless doubles could not hold them.
    """

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    shift: int = 0

    @property
    def centre(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """By what the sums exceed n times ``centre``."""
        return [s % self.n for s in self.sums]

    @property
    def positive(self) -> int:
        """Components with a variance that is more than the rounding of the matrix."""
        floor = self.values[0] * len(self.values) * np.finfo(float).eps
        return int((self.values > max(floor, 0.0)).sum())


def covariance_of(squares: dict[tuple[int, int], int], n: int, rest: list[int]) -> tuple[np.ndarray, int]:
    """Covariances by polarisation from exact sums, divisor ``n``, each rounded once; and their ``shift``."""
    width = len(rest)
    # exact sums of (n x - S)^2, and of (n x_i + n x_j - S_i - S_j)^2
    about = {(i, j): n * n * q - n * (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), q in squares.items()}
    largest = max(about[i, i] for i in range(width)) // n**3
    shift = max(0, (largest.bit_length() - 900) // 2 + 1)
    matrix = np.empty((width, width))
    for i in range(width):
        matrix[i, i] = about[i, i] / (n**3 << 2 * shift)
        for j in range(i + 1, width):
            matrix[i, j] = matrix[j, i] = (about[i, j] - about[i, i] - about[j, j]) / (2 * n**3 << 2 * shift)
    return matrix, shift


def fit(df: DataFrame, vector: str = "vector") -> Whitening | None:
    """Components of the whole numbers of every usable vector of ``df``; None where there is none.

    Usable vectors are neither null nor empty and hold finite entries alone.  Should lengths
    differ, vectors of the commonest length count (of two as common the longer).  The driver
    gets sums of d (d + 1) / 2 pairs; d is checked.
    """
    rows = df.where(usable(vector)).select(vector)
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    width, n = sizes
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {width} entries; at most {MAX_DIMENSIONS}")
    rows = rows.where(F.size(vector) == width)
    sums = column_sums(rows, vector, width)
    squares = centred_squares(rows, vector, [s // n for s in sums])
    matrix, shift = covariance_of(squares, n, [s % n for s in sums])
    values, components = np.linalg.eigh(matrix)
    values, components = values[::-1], components[:, ::-1]
    signs = np.sign(components[np.abs(components).argmax(axis=0), range(width)])
    return Whitening(n, tuple(sums), matrix, values, components * signs, shift)


def _deviations(x: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Exact sums of (n x - rest)^2 of the rows, None where a long does not hold them."""
    safe = x.dtype == object or n * _FAST * x.shape[1] < 1 << 62
    x = x if safe else x.astype(object)
    squares, products = (x * x).sum(axis=1), (x * np.array(rest, x.dtype)).sum(axis=1)
    whole = sum(r * r for r in rest)
    found = [n * n * q - 2 * n * p + whole for q, p in zip(squares.tolist(), products.tolist())]
    return [f if f < 1 << 63 else None for f in found]


def whitened(df: DataFrame, model: Whitening | None, vector: str = "vector", k: int = 8) -> DataFrame:
    """The rows of ``df`` with a vector that was fitted, without it, and with ``deviation`` and ``whitened``.

    ``deviation`` is the exact sum over the dimensions of (n x - S)^2, null where a long does not
    hold it.  ``whitened`` is an array: the centred whole numbers projected on the first ``k``
    components, each over the root of its eigenvalue; null for a component without variance.
    Columns of ``df`` that have these names are replaced; without a model there are no rows.
    """
    kept = [c for c in df.columns if c.lower() not in (vector.lower(), "deviation", "whitened")]
    names = [*kept, "deviation", "whitened"]
    added = {"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")}
    schema = df.select(*[f"`{c}`" for c in kept]).withColumns(added).schema
    width = len(model.sums) if model else 0
    rows = df.where(usable(vector) & (F.size(vector) == width)).select(*[f"`{c}`" for c in kept], f"`{vector}`")
    if model is None:
        return rows.mapInArrow(lambda batches: iter(()), schema)  # none has entries and length 0
    n, centre, rest, unit = model.n, model.centre, model.rest, 1 << model.shift
    used = min(k, width)
    real = min(used, model.positive)
    projection = model.components[:, :real] / np.sqrt(model.values[:real])
    above = np.array([r / n / unit for r in rest])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                near, x, far = _centred(part, len(kept), centre)
                scores = np.empty((part.num_rows, real))
                deviations = np.empty(part.num_rows, object)
                for rows, values in ((near, x), (~near, far)):
                    scaled = (values / unit).astype(float)
                    scores[rows] = (scaled - above) @ projection
                    deviations[rows] = _deviations(values, n, rest)
                filled = [row + [None] * (used - real) for row in scores.tolist()]
                columns = [part.column(i) for i in range(len(kept))]
                made = [pa.array(deviations.tolist(), pa.int64()), pa.array(filled, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=names)

    return rows.mapInArrow(mapped, schema)


def identity_error(rows: DataFrame, model: Whitening | None, k: int = 8) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity; 0 without components.

    Measured over the rows themselves with Spark's ``covar_pop``, which centres before it multiplies.
    Components without variance have no whitened values and are left out.
    """
    real = min(k, model.positive) if model else 0
    pairs = [(i, j) for i in range(real) for j in range(i, real)]
    if not pairs:
        return 0.0
    found = rows.agg(*[F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) for i, j in pairs]).first()
    return float(max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs)))


def components_table(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """One row per fitted vector and component up to ``k``: key, ``component`` from 1, ``n``, ``deviation``,
    ``whitened``, ``explained`` (share of the trace; 0 if there is no variance at all) and ``identity_error``."""
    model = fit(df.select(F.col(vector).alias("vector")))
    rows = whitened(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), model, k=k)
    trace = float(np.trace(model.covariance)) if model else 0.0
    shares = [float(v) / trace if trace else 0.0 for v in model.values[:k]] if model else [0.0]
    return rows.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1).alias("explained"),
        F.lit(identity_error(rows, model, k)).alias("identity_error"),
    )
