"""End-to-end detectors on the order lines and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import (
    LINES,
    NUMBERS,
    SQL_LINES,
    embeddings,
    lines,
    query,
    r,
    rate_columns,
    rounded,
    sql_assign,
    sql_lloyd,
    sql_outcome,
    sql_rates,
)
from farpoint.operators import evaluate
from farpoint.operators.shape import NORMAL
from farpoint.plans import detectors, features
from farpoint.session import scanned, spread

_LLOYD = features.from_first_rows(4)
_SMALL = features.library(10)
_TRAIN, _TEST = "l_orderkey % 5 <> 0", "l_orderkey % 5 = 0"


def sides(spark, sf_dir, deal=spread):
    df = deal(lines(spark, sf_dir))
    return df.filter(_TRAIN), df.filter(_TEST)


def normal_only(df):
    return df.filter(F.col("label") == NORMAL)


def sq6(a, b):
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, 7))


_ENCODED = """enc AS (SELECT id, label, l_orderkey, l_quantity AS e1, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e2,
  CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e3, l_extendedprice AS e4, l_discount AS e5, l_tax AS e6 FROM lines)"""


def _sql_scaled(condition: str) -> str:
    """Encoded rows scaled by the statistics of the training rows."""
    stats = ", ".join(f"avg(e{i}) AS m{i}, stddev_pop(e{i}) AS s{i}" for i in range(1, 7))
    values = ", ".join(f"(e{i} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END" for i in range(1, 7))
    return f"""{SQL_LINES}, {_ENCODED}, st AS (SELECT {stats} FROM enc WHERE {condition}),
    al AS MATERIALIZED (SELECT id, label, l_orderkey, [{values}] AS x FROM enc, st),
    train AS (SELECT * FROM al WHERE {condition}), test AS (SELECT * FROM al WHERE {_TEST})"""


_MAJORITY = f"""WITH {_sql_scaled(_TRAIN)}, {sql_lloyd("train", 6, 4, distance=sq6)},
{sql_assign("a", "train", "c4", "label", sq6)}, {sql_assign("b", "test", "c4", "label", sq6)},
classes AS (SELECT cluster, CASE WHEN count(*) FILTER (label = 'normal.') > count(*) FILTER (label <> 'normal.') THEN 'normal'
  WHEN count(*) FILTER (label = 'normal.') < count(*) FILTER (label <> 'normal.') THEN 'attack' END AS cluster_class
  FROM a GROUP BY cluster),
judged AS (SELECT {sql_outcome("label = 'normal.'", "cluster_class = 'normal'")} AS outcome
  FROM b LEFT JOIN classes USING (cluster)) {sql_rates("judged")}"""


@query("detector_majority_label", _MAJORITY)
def majority_label(spark, sf_dir):
    """Encode, scale, cluster, label clusters by majority, judge the test rows."""
    train, test = sides(spark, sf_dir)
    return rate_columns(
        detectors.majority_detector(train, test, LINES, pca_k=None, k=6, scaling="train", trainer=_LLOYD)
    )


_NORMAL_TRAIN = f"{_TRAIN} AND label = 'normal.'"


@query(
    "detector_centroid_distance",
    f"""WITH {_sql_scaled(_NORMAL_TRAIN)}, {sql_lloyd("train", 6, 4, distance=sq6)}, {sql_assign("b", "test", "c4", "label", sq6)},
    judged AS (SELECT {sql_outcome("label = 'normal.'", "d < 2.75")} AS outcome FROM b) {sql_rates("judged")}""",
)
def centroid_distance(spark, sf_dir):
    """Centres of normal rows only; far rows are attacks."""
    train, test = sides(spark, sf_dir)
    return rate_columns(
        detectors.distance_detector(
            normal_only(train), test, LINES, train, epsilon=2.75, pca_k=None, k=6, one_hot=True, sumsq_cap=None, trainer=_LLOYD
        )
    )


_STATE_SQL = f"""WITH {SQL_LINES}, st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in NUMBERS)}
  FROM lines WHERE {_TRAIN}),
al AS MATERIALIZED (SELECT id, label, l_orderkey,
  [{", ".join(f"CASE WHEN q_{c} >= 2e8 THEN {c} - m_{c} ELSE ({c} - m_{c}) / s_{c} END" for c in NUMBERS)}] AS x FROM lines, st),
train AS (SELECT * FROM al WHERE {_TRAIN}), test AS (SELECT * FROM al WHERE {_TEST})"""


def _sq4(a, b):
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, 5))


@query(
    "report_cluster_labels",
    f"""{_STATE_SQL}, {sql_lloyd("train", 5, 4, distance=_sq4)}, {sql_assign("b", "test", "c4", "label", _sq4)}
    SELECT cluster::INTEGER AS cluster, label, count(*) AS count,
      cluster::VARCHAR || lpad(label, 18, ' ') || lpad(count(*)::VARCHAR, 8, ' ') AS line
    FROM b GROUP BY cluster, label""",
)
def cluster_labels(spark, sf_dir):
    """Test rows per cluster and label, scaled by the training rows with the guard."""
    train, test = sides(spark, sf_dir)
    return detectors.cluster_label_report(train, test, LINES, 5, trainer=_LLOYD)


@query("report_clustered_rows")
def clustered_rows(spark, sf_dir):
    """Three clusters of raw rows, the record beside its cluster."""
    df = detectors.cluster_rows(lines(spark, sf_dir), LINES, 3)
    return df.select("id", "l_returnflag", "cluster", rounded("sq_distance").alias("sq_distance"))


@query("report_all_components")
def all_components(spark, sf_dir):
    df = detectors.project_all(lines(spark, sf_dir), LINES)
    return df.select("id", *[rounded(F.col("features")[i], 4).alias(f"pc{i}") for i in range(4)])


@query("detector_numeric_majority")
def numeric_majority(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return detectors.numeric_majority_detector(train, test, LINES, pca_k=3, k=20, trainer=_SMALL)


@query("detector_scaled_majority")
def scaled_majority(spark, sf_dir):
    train, test = sides(spark, sf_dir, scanned)
    return detectors.scaled_majority_detector(train, test, LINES, pca_k=3, k=20, trainer=_SMALL)


@query("detector_projected_majority")
def projected_majority(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return detectors.majority_detector(train, test, LINES, pca_k=4, k=20, scaling="train", trainer=_SMALL)


@query("detector_two_level")
def two_level(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return detectors.two_level_detector(train, test, LINES, pca_k=4, k=12, iterations=5, trainer=_SMALL)


@query("detector_encoded_distance")
def encoded_distance(spark, sf_dir):
    train, test = sides(spark, sf_dir, scanned)
    return detectors.encoded_distance_detector(
        normal_only(train), test, train, LINES, epsilon=1e6, pca_k=4, k=20, trainer=features.library(10, runs=2, tol=1e-6)
    )


@query("detector_own_scaled_distance")
def own_scaled_distance(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    table, cost = detectors.own_scaled_distance_detector(
        normal_only(train), test, train, LINES, epsilon=1.0, pca_k=4, k=20, trainer=features.library(10, runs=2, tol=1e-6)
    )
    return table.withColumn("training_cost", F.lit(cost))


@query("detector_cascade")
def cascade(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return detectors.cascade_detector(
        train, normal_only(train), test, LINES, 1e6, 4, 12, 10, normal_trainer=_SMALL, mixed_trainer=_SMALL
    )


@query("features_center_distances")
def center_distances(spark, sf_dir):
    """log, components, five centres: distances of every row to all centres."""
    train, test = sides(spark, sf_dir, scanned)
    tables = detectors.distance_features(train, [test], LINES, 3, 5, trainer=_LLOYD)
    both = tables[0].withColumn("part", F.lit("train")).unionByName(tables[1].withColumn("part", F.lit("test")))
    return both.select("id", "part", *[rounded(F.col("dists")[i], 5).alias(f"d{i}") for i in range(5)])


@query("detector_outlier_degree")
def outlier_degree(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    df = detectors.outlier_degree_detector(normal_only(train), test, train, LINES, 4, 12, trainer=_SMALL)
    return evaluate.rates(evaluate.confusion(df))


@query("detector_weighted_lof")
def weighted_lof(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    df = detectors.lof_detector(normal_only(train), test, train, LINES, 4, 20, 5, trainer=_SMALL)
    return evaluate.rates(evaluate.confusion(df))


@query("detector_plain_lof")
def plain_lof(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    df = detectors.lof_detector(
        normal_only(train), test, train, LINES, 4, 20, 5, weighted=False, fixed_threshold=1.0, trainer=_SMALL
    )
    return evaluate.rates(evaluate.confusion(df))


@query("detector_two_stage_lof")
def two_stage_lof(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    normal = normal_only(train)
    df = detectors.two_stage_lof_detector(
        normal.filter("l_partkey % 2 = 0"), normal.filter("l_partkey % 2 = 1"), test, train, LINES, 4, 20, 5, trainer=_SMALL
    )
    return evaluate.rates(evaluate.confusion(df))


@query("detector_exact_lof")
def exact_lof(spark, sf_dir):
    """Odd rows judged against even rows of the embeddings."""
    df = embeddings(spark, sf_dir)
    report = detectors.exact_lof_report(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"))
    return report.select("id", rounded("lof").alias("lof"), "outlier")


@query("sweep_mean_distance")
def sweep_mean_distance(spark, sf_dir):
    found = detectors.sweep_distance(spread(lines(spark, sf_dir)), range(5, 21, 5), LINES, scaling="train", trainer=_SMALL)
    return found.scores


@query("sweep_label_entropy")
def sweep_label_entropy(spark, sf_dir):
    return detectors.sweep_entropy(spread(lines(spark, sf_dir)), (4, 8, 12), LINES, _SMALL).scores


@query("sweep_best_sample")
def sweep_best_sample(spark, sf_dir):
    return detectors.best_k_sample(spread(lines(spark, sf_dir)), LINES, (4, 8), trainer=features.library(10, runs=2, init="random"))


@query("sweep_threshold_grid")
def sweep_threshold_grid(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return detectors.threshold_sweep(
        normal_only(train), test, LINES, (0.5, 1.0, 2.0, 4.0), (2, 3), (2, 5), scaling="train", trainer=_LLOYD
    )


@query("detector_top_anomalies")
def top_anomalies(spark, sf_dir):
    df = detectors.top_anomalies(spread(lines(spark, sf_dir)), LINES, 20, trainer=_SMALL)
    return df.select("id", "l_returnflag", *NUMBERS, rounded("distance").alias("distance"))
