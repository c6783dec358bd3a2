"""Cut-offs on anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions import vectors

_SORT_AT_MOST = 50_000
_SKETCH = 2_000


def below(distance: Column, threshold: float) -> Column:
    """normal under the threshold, attack from the threshold on."""
    return F.when(distance < threshold, "normal").otherwise("attack")


def above(distance: Column, threshold: float) -> Column:
    """True for an anomaly: strictly over the threshold."""
    return distance > threshold


def order_statistic(df: DataFrame, column: str, rank: int, ascending: bool = True) -> float:
    """The exact value at a 1-based rank, without sorting the data.

    Near either end the rank is a small top-k.  Elsewhere each round takes two quantile
    estimates around the rank, counts the rows below and between them, and goes on with
    the rows between; the sketch bounds the rest to a fixed share of the round's rows.
    A value that many rows share is recognised by its own count, so ties do not stall
    it.  Only the last few rows are sorted.
    """
    if rank < 1:
        raise ValueError(f"rank {rank} is below 1")
    scores = _scores(df, column, ascending)
    sign = 1 if ascending else -1
    if rank <= _SORT_AT_MOST:
        row = _end_of(scores, rank)
        if row.n < rank:
            raise ValueError(f"rank {rank} outside 1..{row.n}")
        return row.v * sign
    scores.persist()
    try:
        return _select(scores, rank, scores.count()) * sign
    finally:
        scores.unpersist()


def _scores(df: DataFrame, column: str, ascending: bool) -> DataFrame:
    """One column ``s`` whose small end is the wanted one."""
    s = F.col(column).cast("double")
    return df.select((s if ascending else -s).alias("s")).filter(F.col("s").isNotNull())


def _end_of(scores: DataFrame, rank: int):
    """Count and largest of the ``rank`` smallest scores."""
    return scores.orderBy("s").limit(rank).agg(F.count("*").alias("n"), F.max("s").alias("v")).first()


def _select(scores: DataFrame, rank: int, total: int) -> float:
    if not 1 <= rank <= total:
        raise ValueError(f"rank {rank} outside 1..{total}")
    s = F.col("s")
    low, high, span, left, target = None, None, scores, total, rank
    while left > _SORT_AT_MOST and target > _SORT_AT_MOST:
        share, slack = target / left, 2.0 / _SKETCH
        points = [max(0.0, share - slack), min(1.0, share + slack)]
        a, b = span.agg(F.percentile_approx("s", points, _SKETCH).alias("q")).first().q
        row = span.agg(
            F.count_if(s < a).alias("below"),
            F.count_if(s == a).alias("at_a"),
            F.count_if(s <= b).alias("upto"),
            F.count_if(s == b).alias("at_b"),
        ).first()
        if target <= row.below:
            high, left = a, row.below
        elif target <= row.below + row.at_a:
            return a
        elif target > row.upto:
            low, target, left = b, target - row.upto, left - row.upto
        elif target > row.upto - row.at_b:
            return b
        else:
            skipped = row.below + row.at_a
            low, high, target, left = a, b, target - skipped, row.upto - row.at_b - skipped
        span = scores
        if low is not None:
            span = span.filter(s > low)
        if high is not None:
            span = span.filter(s < high)
    return _end_of(span, target).v


def nth_largest(df: DataFrame, column: str, n: int = 100) -> float:
    """The n-th largest score: rows over it are anomalies."""
    return order_statistic(df, column, n, ascending=False)


def percent_position(
    df: DataFrame, column: str, percent: float, ascending: bool = True, zero_based: bool = False
) -> float:
    """Score at position ``floor(n * percent / 100)`` of the ordered list.

    Positions count from 1; ``zero_based`` counts from 0, one row further on.  The
    scores are worked out once and held while they are counted and narrowed down.
    """
    scores = _scores(df, column, ascending).persist()
    try:
        total = scores.count()
        rank = max(1, int(total * percent // 100) + (1 if zero_based else 0))
        if total - rank < rank and total - rank < _SORT_AT_MOST:
            value = -_end_of(scores.select((-F.col("s")).alias("s")), total - rank + 1).v
        else:
            value = _select(scores, rank, total)
        return value if ascending else -value
    finally:
        scores.unpersist()


def top_rows(df: DataFrame, condition: Column, score: str, order: Sequence[str], limit: int = 10) -> DataFrame:
    """The most anomalous rows that satisfy a condition."""
    return df.filter(condition).orderBy(F.col(score).desc(), *order).limit(limit)


def cascade(distance_to_normal: Column, threshold: float, second_class: Column) -> Column:
    """attack when far from every normal-only centre, else what the second model says."""
    return F.when(distance_to_normal >= threshold, "attack").otherwise(second_class)


def outlier_degree(features: Column, centers: np.ndarray) -> Column:
    """``k / sum of squared distances to all k centres``; low means outlier."""
    return F.lit(float(len(centers))) / vectors.total_center_distance(features, centers)


def accepted_ids(df: DataFrame, predicted: Column, key: str = "id") -> DataFrame:
    """Keys of the rows a detector accepts."""
    return df.filter(predicted).select(key)
