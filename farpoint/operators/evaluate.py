"""Outcomes, confusion counts and rates; sweeps over thresholds; run reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions import vectors

OUTCOMES = ("TP", "FP", "TN", "FN")


def outcome(is_normal: Column, judged_normal: Column, positive: str = "normal") -> Column:
    """TP, FP, TN or FN; ``noclass`` where the judgement is null."""
    if positive == "normal":
        truth, judged = is_normal, judged_normal
    elif positive == "attack":
        truth, judged = ~is_normal, ~judged_normal
    else:
        raise ValueError(f"positive must be normal or attack, not {positive}")
    return (
        F.when(judged & truth, "TP")
        .when(judged & ~truth, "FP")
        .when(~judged & ~truth, "TN")
        .when(~judged & truth, "FN")
        .otherwise("noclass")
    )


def judged_by_score(score: Column, threshold: float) -> Column:
    """True under the threshold, false over it, null on it."""
    return F.when(score < threshold, True).when(score > threshold, False)


def judged_by_class(name: Column) -> Column:
    """True for normal, false for attack, null for no class."""
    return name == "normal"


def outcome_counts(df: DataFrame, column: str = "outcome") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, column: str = "outcome", by: Sequence[str] = ()) -> DataFrame:
    """Counts ``tp fp tn fn`` and ``noclass``; all from 0, in one aggregate."""
    counts = [F.count_if(F.col(column) == o).alias(o.lower()) for o in (*OUTCOMES, "noclass")]
    return df.groupBy(*by).agg(*counts) if by else df.agg(*counts)


def weighted_confusion(
    counts: DataFrame, is_normal: Column, judged_normal: Column, n: str = "count", positive: str = "normal"
) -> DataFrame:
    """Confusion from cluster x label counts instead of rows."""
    result = outcome(is_normal, judged_normal, positive)
    sums = [
        F.coalesce(F.sum(F.when(result == o, F.col(n))), F.lit(0)).cast("long").alias(o.lower())
        for o in (*OUTCOMES, "noclass")
    ]
    return counts.agg(*sums)


def rates(table: DataFrame) -> DataFrame:
    """Add precision, recall and accuracy as fractions, null when undefined."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return table.withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
        }
    )


def counts_per_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def threshold_grid(
    df: DataFrame,
    score: Column,
    is_normal: Column,
    thresholds: Sequence[float],
    by: Sequence[str] = (),
    positive: str = "normal",
) -> DataFrame:
    """Confusion counts for every threshold in one pass over the rows.

    Rows at or over the threshold are judged attack.
    """
    sums = []
    for i, epsilon in enumerate(thresholds):
        result = outcome(is_normal, score < F.lit(float(epsilon)), positive)
        sums += [F.count_if(result == o).alias(f"{o.lower()}_{i}") for o in OUTCOMES]
    wide = df.groupBy(*by).agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(epsilon)).alias("epsilon"), *[F.col(f"{o.lower()}_{i}").alias(o.lower()) for o in OUTCOMES]
            )
            for i, epsilon in enumerate(thresholds)
        ]
    )
    return rates(wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*"))


def model_grid(
    df: DataFrame,
    models: Mapping[int, np.ndarray],
    is_normal: Column,
    thresholds: Sequence[float],
    features: str = "features",
    positive: str = "normal",
) -> DataFrame:
    """:func:`threshold_grid` for several sets of centres, named by their k: one pass over
    the rows for all models and all thresholds."""
    names = F.array(*[F.lit(int(k)) for k in models])
    found = df.select(
        is_normal.alias("_normal"), vectors.nearest_distances(F.col(features), list(models.values())).alias("_d")
    )
    found = found.select("_normal", F.posexplode("_d").alias("_at", "_score"))
    found = found.withColumn("k", names[F.col("_at")])
    return threshold_grid(found, F.col("_score"), F.col("_normal"), thresholds, ["k"], positive)


def write_run_reports(table: DataFrame, path: str, run: Column, mode: str = "errorifexists") -> None:
    """One folder of text per run, with a line per counter: ``TP is : 57685``."""
    lines = F.array(*[F.concat(F.lit(f"{o} is : "), F.col(o.lower()).cast("string")) for o in OUTCOMES])
    table.select(run.alias("run"), F.explode(lines).alias("value")).write.partitionBy("run").mode(mode).text(path)


def rollup_reports(lines: DataFrame, run: str = "run", value: str = "value") -> DataFrame:
    """Accuracy report over many runs from their counter lines.

    Lines that are not counters are ignored, so other text in a run's folder does no harm.
    """
    pattern = r"^\s*(TP|FP|TN|FN) is\s*:\s*(\d+)(?:\.0*)?\s*$"
    found = lines.select(
        run, F.regexp_extract(value, pattern, 1).alias("name"), F.regexp_extract(value, pattern, 2).alias("n")
    ).filter(F.col("name") != "")
    wide = found.groupBy(run).pivot("name", list(OUTCOMES)).agg(F.max(F.col("n").cast("long")))
    return rates(wide.withColumnsRenamed({o: o.lower() for o in OUTCOMES}))
