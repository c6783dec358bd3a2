"""Column statistics and standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.functions import vectors


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n, sum, sum of squares, mean, population stdev; one scan."""
    measures = []
    for c in columns:
        x = F.col(c).cast("double")
        measures += [
            F.count(x).alias(f"{c}__n"),
            F.sum(x).alias(f"{c}__total"),
            F.sum(x * x).alias(f"{c}__total_sq"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_pop(x).alias(f"{c}__sd"),
        ]
    wide = df.agg(*measures)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                *[F.col(f"{c}__{m}").alias(m) for m in ("n", "total", "total_sq", "mean", "sd")],
            )
            for c in columns
        ]
    )
    return wide.select(F.explode(rows).alias("s")).select("s.*")


@dataclass(frozen=True)
class ColumnScaler:
    """Mean and divisor per named column; divisor 0 means: centre only."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Scaled columns as plain arithmetic, inside whole-stage codegen."""
        scaled = {}
        for c, mean, sd in zip(self.columns, self.mean, self.sd):
            centred = F.col(c).cast("double") - F.lit(mean)
            scaled[f"{c}{suffix}"] = centred / F.lit(sd) if sd > 0 else centred
        return df.withColumns(scaled)


def fit_columns(
    df: DataFrame, columns: Sequence[str], sumsq_cap: float | None = None, sample: bool = False
) -> ColumnScaler:
    """Statistics of the given rows.

    ``sumsq_cap``: a column whose sum of squares reaches the cap is only centred.
    ``sample``: divide by the n-1 deviation instead of the population one.
    """
    by_name = {r.feature: r for r in column_stats(df, columns).collect()}
    mean, sd = [], []
    for c in columns:
        row = by_name[c]
        if not row.n:
            raise ValueError("cannot scale: no rows")
        deviation = row.sd
        if sample:
            deviation = deviation * (row.n / (row.n - 1)) ** 0.5 if row.n > 1 else 0.0
        if sumsq_cap is not None and row.total_sq >= sumsq_cap:
            deviation = 0.0
        mean.append(row["mean"])
        sd.append(deviation)
    return ColumnScaler(tuple(columns), tuple(mean), tuple(sd))


@dataclass(frozen=True)
class VectorScaler:
    """Mean and divisor per element of a feature array; divisor 1 where sd is 0."""

    mean: np.ndarray
    divisor: np.ndarray

    def transform(self, df: DataFrame, features: str = "features", output: str | None = None) -> DataFrame:
        return df.withColumn(output or features, vectors.shift_and_divide(F.col(features), self.mean, self.divisor))


def fit_vectors(
    df: DataFrame,
    features: str = "features",
    sumsq_cap: float | None = None,
    sample: bool = False,
    with_std: bool = True,
) -> VectorScaler:
    """As :func:`fit_columns` for an array column, in one aggregate."""
    vector = array_to_vector(F.col(features))
    row = df.agg(Summarizer.metrics("count", "mean", "std", "normL2").summary(vector).alias("s")).first().s
    n = row["count"]
    if not n:
        raise ValueError("cannot scale: no rows")
    mean, sd = row["mean"].toArray(), row["std"].toArray()
    if not sample:
        sd = sd * np.sqrt((n - 1) / n)
    if sumsq_cap is not None:
        sd = np.where(row["normL2"].toArray() ** 2 >= sumsq_cap, 0.0, sd)
    if not with_std:
        sd = np.zeros_like(sd)
    return VectorScaler(mean, np.where(sd > 0, sd, 1.0))


def log1p_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in columns})


def log1p_features(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn(features, vectors.log1p_each(F.col(features)))
