"""Outcomes, confusion counts, rates, threshold grids and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import (
    SQL_EMBEDDINGS,
    SQL_SCALED,
    SQL_TOPIC_CENTERS,
    embeddings,
    query,
    r,
    rate_columns,
    sq4,
    sql_assign,
    sql_lloyd,
    sql_outcome,
    sql_rates,
    table,
)
from farpoint.catalog.clusters import L_K, SQL_L_LLOYD, line_centers, stored_lines
from farpoint.catalog.distances import topic_centers
from farpoint.operators import evaluate, kmeans, labelling
from farpoint.session import scratch_path
from farpoint.sources import records

_TRUTH, _JUDGED = "quality = 1", "n_chars >= 800"


def _documents_sql(positive="normal"):
    return f"""judged AS (SELECT doc_id, {sql_outcome(_TRUTH, _JUDGED, positive)} AS outcome
      FROM labels JOIN documents USING (doc_id))"""


def judged_documents(spark, sf_dir, positive="normal"):
    """Labelled documents; good quality is the normal class, length the judgement."""
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    result = evaluate.outcome(F.col("quality") == 1, F.col("n_chars") >= 800, positive)
    return df.select("doc_id", result.alias("outcome"))


@query("e1_outcome_positive_normal", f"WITH {_documents_sql()} SELECT doc_id, outcome FROM judged")
def outcome_positive_normal(spark, sf_dir):
    return judged_documents(spark, sf_dir)


@query("e2_outcome_positive_attack", f"WITH {_documents_sql('attack')} SELECT doc_id, outcome FROM judged")
def outcome_positive_attack(spark, sf_dir):
    return judged_documents(spark, sf_dir, "attack")


@query("e3_outcome_counts", f"WITH {_documents_sql()} SELECT outcome, count(*) AS n FROM judged GROUP BY outcome")
def outcome_counts(spark, sf_dir):
    return evaluate.outcome_counts(judged_documents(spark, sf_dir))


_CLASSES = """classes AS (SELECT cluster, CASE WHEN count(*) FILTER (label = 'normal.') > count(*) FILTER (label <> 'normal.') THEN 'normal'
  WHEN count(*) FILTER (label = 'normal.') < count(*) FILTER (label <> 'normal.') THEN 'attack' END AS cluster_class
  FROM a GROUP BY cluster)"""


@query(
    "e3_weighted_confusion",
    f"""WITH {SQL_L_LLOYD}, {_CLASSES}, judged AS (
      SELECT {sql_outcome("label = 'normal.'", "cluster_class = 'normal'")} AS outcome FROM a JOIN classes USING (cluster))
    {sql_rates("judged")}""",
)
def weighted_confusion(spark, sf_dir):
    """Confusion from cluster x label counts, weighted by the counts."""
    df = stored_lines(spark, sf_dir)
    centers = line_centers(df)
    assigned = centers.assign(df)
    is_normal = F.col("label") == "normal."
    classes = labelling.majority(labelling.class_counts(assigned, L_K, is_normal))
    counts = labelling.attach_class(kmeans.label_counts(assigned), classes)
    table_ = evaluate.weighted_confusion(counts, is_normal, evaluate.judged_by_class(F.col("cluster_class")))
    return rate_columns(evaluate.rates(table_))


@query("e4_rates", f"WITH {_documents_sql()} {sql_rates('judged')}")
def rates(spark, sf_dir):
    return rate_columns(evaluate.rates(evaluate.confusion(judged_documents(spark, sf_dir))))


@query(
    "e5_unlabelled_clusters",
    f"""WITH {SQL_EMBEDDINGS}, {SQL_TOPIC_CENTERS}, {sql_assign("a", "pts", "centers", "label")},
    judged AS (SELECT CASE WHEN cluster IN (3, 7) THEN 'noclass'
      ELSE {sql_outcome("label = 'normal.'", "cluster < 8")} END AS outcome FROM a) {sql_rates("judged")}""",
)
def unlabelled_clusters(spark, sf_dir):
    """Rows of clusters that have no class are counted apart."""
    classes = spark.createDataFrame(
        [(c, "normal" if c < 8 else "attack") for c in range(10) if c not in (3, 7)], "cluster int, cluster_class string"
    )
    judged = labelling.attach_class(topic_centers(spark, sf_dir).assign(embeddings(spark, sf_dir)), classes)
    result = evaluate.outcome(F.col("label") == "normal.", evaluate.judged_by_class(F.col("cluster_class")))
    return rate_columns(evaluate.rates(evaluate.confusion(judged.withColumn("outcome", result))))


# --- sweeps and reports ------------------------------------------------------

_EPSILONS = (0.9, 1.7, 2.6, 4.1)
_GRID_KS = (2, 5)


def _sql_grid():
    parts, tables = [SQL_SCALED], []
    for k in _GRID_KS:
        parts.append(sql_lloyd("pts", k, 2, prefix=f"g{k}c", distance=sq4))
        parts.append(sql_assign(f"g{k}", "pts", f"g{k}c2", "label", sq4))
        for epsilon in _EPSILONS:
            result = sql_outcome("label = 'normal.'", f"d < {epsilon}")
            tables.append(f"SELECT {k}::INTEGER AS k, {epsilon}::DOUBLE AS epsilon, {result} AS outcome FROM g{k}")
    parts.append(f"judged AS ({' UNION ALL '.join(tables)})")
    return "WITH " + ", ".join(parts)


_GRID = _sql_grid()


def grid(spark, sf_dir):
    """All models and all thresholds in one pass over the rows."""
    df = stored_lines(spark, sf_dir)
    models = {k: kmeans.lloyd(df, kmeans.first_rows(df, k, ["id"]), 2).matrix for k in _GRID_KS}
    return evaluate.model_grid(df, models, F.col("label") == "normal.", _EPSILONS)


@query("e7_threshold_grid", f"{_GRID} SELECT * EXCLUDE (noclass) FROM ({sql_rates('judged', by='k, epsilon')})")
def threshold_grid(spark, sf_dir):
    return rate_columns(grid(spark, sf_dir))


@query(
    "e8_report_rollup",
    f"""{_GRID} SELECT 'k' || k || '_e' || epsilon AS run, tp, fp, tn, fn,
      {r("tp::DOUBLE / nullif(tp + fp, 0)")} AS precision, {r("tp::DOUBLE / nullif(tp + fn, 0)")} AS recall,
      {r("(tp + tn)::DOUBLE / (tp + fp + tn + fn)")} AS accuracy
    FROM ({sql_rates('judged', by='k, epsilon')})""",
)
def report_rollup(spark, sf_dir):
    """Counter lines, one folder per run, rolled up into one table."""
    path = scratch_path(spark, "runs")
    run = F.concat(F.lit("k"), F.col("k").cast("string"), F.lit("_e"), F.col("epsilon").cast("string"))
    evaluate.write_run_reports(grid(spark, sf_dir), path, run)
    return rate_columns(evaluate.rollup_reports(records.read_lines(spark, path)))
