"""From cluster x label counts to cluster classes; two-level clustering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions import vectors
from farpoint.operators.kmeans import Centers, sum_arrays
from farpoint.operators.shape import first_per_group


def class_counts(assigned: DataFrame, k: int, is_normal: Column, cluster: str = "cluster") -> DataFrame:
    """``(cluster, normal, attack)`` for every id 0..k-1, zeros where nothing fell."""
    found = assigned.groupBy(cluster).agg(
        F.count_if(is_normal).alias("normal"), F.count_if(~is_normal).alias("attack")
    )
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias(cluster))
    return every.join(found, cluster, "left").fillna(0, ["normal", "attack"])


def majority(counts: DataFrame, output: str = "cluster_class") -> DataFrame:
    """normal or attack, whichever has more rows; null on a tie or when empty."""
    name = F.when(F.col("normal") > F.col("attack"), "normal").when(F.col("attack") > F.col("normal"), "attack")
    return counts.withColumn(output, name)


def impure(counts: DataFrame, low: float = 0.2, high: float = 0.8, force: Sequence[int] = ()) -> DataFrame:
    """Clusters whose normal or attack share lies strictly between the bounds.

    An empty cluster is never impure; ``force`` adds ids by hand.
    """
    total = F.col("normal") + F.col("attack")

    def between(part: str) -> Column:
        share = F.try_divide(F.col(part).cast("double"), total)
        return F.coalesce((share > low) & (share < high), F.lit(False))

    mixed = between("normal") | between("attack")
    if force:
        mixed = mixed | F.col("cluster").isin([int(c) for c in force])
    return counts.filter(mixed)


def attach_class(assigned: DataFrame, classes: DataFrame, on: Sequence[str] = ("cluster",)) -> DataFrame:
    """Left join of the class table; rows of an unlabelled cluster get null.

    The table has one row per cluster, so it is broadcast.
    """
    return assigned.join(F.broadcast(classes.select(*on, "cluster_class")), list(on), "left")


@dataclass(frozen=True)
class TwoLevel:
    """First-level centres and, for some of them, second-level centres."""

    top: Centers
    sub: dict[int, np.ndarray]

    def assign(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``cluster`` and ``sub``; sub is null where there is no second level."""
        return assign_sub(self.top.assign(df, features), self.sub, features)

    def sub_table(self, spark) -> DataFrame:
        rows = [(p, s, [float(v) for v in c]) for p, m in sorted(self.sub.items()) for s, c in enumerate(m)]
        return spark.createDataFrame(rows, "cluster int, sub int, center array<double>")


def assign_sub(assigned: DataFrame, sub: dict[int, np.ndarray], features: str = "features") -> DataFrame:
    """Nearest sub-centre among those of the row's own cluster."""

    @F.arrow_udf("int")
    def nearest_sub(parents: pa.Array, column: pa.Array) -> pa.Array:
        x = vectors.to_matrix(column)
        parent = parents.to_numpy(zero_copy_only=False)
        out = np.full(len(x), -1, dtype=np.int32)
        for p in np.unique(parent):
            if p in sub:
                mine = parent == p
                out[mine] = vectors.nearest(x[mine], sub[p])[0]
        return pa.array(out, mask=out < 0)

    return assigned.withColumn("sub", vectors.once(nearest_sub, F.col("cluster"), F.col(features)))


def train_sub(
    assigned: DataFrame,
    parents: Sequence[int],
    k: int,
    iterations: int,
    order: Sequence[str],
    features: str = "features",
) -> dict[int, np.ndarray]:
    """Second-level Lloyd inside every parent cluster, all parents in the same rounds.

    Each round is one scan that hands on one partial sum per task and sub-cluster, so
    neither the number of parents nor the size of one of them adds jobs or tasks.
    """
    if not parents:
        return {}
    inside = assigned.filter(F.col("cluster").isin([int(p) for p in parents])).select("cluster", features, *order)
    inside.persist()
    try:
        sub: dict[int, list] = {}
        for row in first_per_group(inside, "cluster", order, k).orderBy("cluster", *order).collect():
            sub.setdefault(row.cluster, []).append(row[features])
        centers = {p: np.array(rows, dtype=float) for p, rows in sub.items()}
        for _ in range(iterations):
            moved = {p: m.copy() for p, m in centers.items()}
            for row in _sub_sums(inside.select("cluster", features), centers).collect():
                moved[row.cluster][row.sub] = np.asarray(row.total) / row.n
            still = all(np.array_equal(moved[p], centers[p]) for p in centers)
            centers = moved
            if still:
                break
        return centers
    finally:
        inside.unpersist()


def _sub_sums(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    d = next(iter(centers.values())).shape[1]
    slots = [(p, s) for p, m in sorted(centers.items()) for s in range(len(m))]
    first = {}
    for position, (p, s) in enumerate(slots):
        first.setdefault(p, position)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(slots)), np.zeros((len(slots), d))
        for batch in batches:
            parent = batch.column(0).to_numpy(zero_copy_only=False)
            x = vectors.to_matrix(batch.column(1), d)
            slot = np.empty(len(x), dtype=np.int64)
            for p in np.unique(parent):
                mine = parent == p
                slot[mine] = first[p] + vectors.nearest(x[mine], centers[p])[0]
            n += np.bincount(slot, minlength=len(slots))
            for j in range(d):
                total[:, j] += np.bincount(slot, weights=x[:, j], minlength=len(slots))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([slots[i][0] for i in used], pa.int32()),
                pa.array([slots[i][1] for i in used], pa.int32()),
                pa.array(n[used].astype(np.int64)),
                vectors.to_lists(total[used]) if len(used) else pa.array([], pa.list_(pa.float64())),
            ],
            names=["cluster", "sub", "n", "total"],
        )

    parts = rows.mapInArrow(partial, "cluster int, sub int, n long, total array<double>")
    return parts.groupBy("cluster", "sub").agg(F.sum("n").alias("n"), sum_arrays(F.col("total")).alias("total"))


def sub_classes(assigned: DataFrame, is_normal: Column) -> DataFrame:
    """Majority class per ``(cluster, sub)``; two columns, so no key can collide."""
    counts = (
        assigned.filter(F.col("sub").isNotNull())
        .groupBy("cluster", "sub")
        .agg(F.count_if(is_normal).alias("normal"), F.count_if(~is_normal).alias("attack"))
    )
    return majority(counts)


def attach_two_level_class(assigned: DataFrame, top: DataFrame, sub: DataFrame) -> DataFrame:
    """Class of the sub-cluster where there is one, else of the cluster."""
    first = F.broadcast(top.select("cluster", F.col("cluster_class").alias("_top")))
    second = F.broadcast(sub.select("cluster", "sub", F.col("cluster_class").alias("_sub")))
    joined = assigned.join(first, "cluster", "left").join(second, ["cluster", "sub"], "left")
    name = F.when(F.col("sub").isNotNull(), F.col("_sub")).otherwise(F.col("_top"))
    return joined.withColumn("cluster_class", name).drop("_top", "_sub")
