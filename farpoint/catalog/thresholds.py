"""Cut-offs on distances and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import (
    SQL_EMBEDDINGS,
    SQL_TOPIC_CENTERS,
    embeddings,
    lines,
    query,
    r,
    rounded,
    sq,
    sql_assign,
    sql_lloyd,
)
from farpoint.catalog.clusters import (
    SQL_E_LLOYD,
    SQL_L_LLOYD,
    embedding_centers,
    line_centers,
    stored_lines,
)
from farpoint.catalog.distances import topic_centers
from farpoint.operators import kmeans, labelling, threshold

_N = "(SELECT count(*) FROM a)"


def scored_lines(spark, sf_dir):
    """Scaled lines with the distance to their centre."""
    df = stored_lines(spark, sf_dir)
    return line_centers(df).assign(df).withColumn("score", F.sqrt("sq_distance"))


def _value(spark, value):
    return spark.range(1).select(rounded(F.lit(float(value))).alias("threshold"))


@query("t1_fixed_threshold", f"WITH {SQL_L_LLOYD} SELECT id, CASE WHEN d < 1.9 THEN 'normal' ELSE 'attack' END AS judged FROM a")
def fixed_threshold(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    return df.select("id", threshold.below(F.col("sq_distance"), 1.9).alias("judged"))


@query(
    "t2_nth_largest",
    f"WITH {SQL_L_LLOYD} SELECT id, {r('sqrt(d)')} AS score FROM a QUALIFY count(*) OVER (ORDER BY d DESC) < 100",
)
def nth_largest(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    cut = threshold.nth_largest(df, "score", 100)
    return df.filter(threshold.above(F.col("score"), cut)).select("id", rounded("score").alias("score"))


@query(
    "t3_percent_ascending",
    f"""WITH {SQL_L_LLOYD} SELECT {r('sqrt(max(d))')} AS threshold FROM (
      SELECT d, row_number() OVER (ORDER BY d) AS n FROM a) WHERE n <= {_N} * 98 // 100""",
)
def percent_ascending(spark, sf_dir):
    return _value(spark, threshold.percent_position(scored_lines(spark, sf_dir), "score", 98))


@query(
    "t4_percent_descending",
    f"""WITH {SQL_L_LLOYD} SELECT {r('sqrt(min(d))')} AS threshold FROM (
      SELECT d, row_number() OVER (ORDER BY d DESC) AS n FROM a) WHERE n <= {_N} * 5 // 100""",
)
def percent_descending(spark, sf_dir):
    return _value(spark, threshold.percent_position(scored_lines(spark, sf_dir), "score", 5, ascending=False))


@query(
    "t5_percent_zero_based",
    f"""WITH {SQL_L_LLOYD} SELECT {r('sqrt(d)')} AS threshold FROM (
      SELECT d, row_number() OVER (ORDER BY d DESC) - 1 AS n FROM a) WHERE n = 2 * {_N} // 100""",
)
def percent_zero_based(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    return _value(spark, threshold.percent_position(df, "score", 2, ascending=False, zero_based=True))


@query(
    "t6_most_anomalous_rows",
    f"""WITH {SQL_L_LLOYD}, t AS (SELECT min(d) AS t FROM (SELECT d FROM a ORDER BY d DESC LIMIT 100))
    SELECT a.id, l_returnflag, l_quantity, {r('sqrt(d)')} AS score FROM a JOIN lines USING (id), t WHERE d > t
    ORDER BY d DESC, a.id LIMIT 10""",
)
def most_anomalous_rows(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    cut = threshold.nth_largest(df, "score", 100)
    top = threshold.top_rows(df, threshold.above(F.col("score"), cut), "score", ["id"])
    found = lines(spark, sf_dir).join(F.broadcast(top.select("id", "score")), "id")
    return found.select("id", "l_returnflag", "l_quantity", rounded("score").alias("score"))


@query(
    "t7_cascade",
    f"""WITH {SQL_EMBEDDINGS}, normal AS (SELECT * FROM pts WHERE label = 'normal.'),
    {sql_lloyd("normal", 6, 2, "n")}, {sql_lloyd("pts", 8, 2, "m")},
    {sql_assign("first", "pts", "n2")}, {sql_assign("second", "pts", "m2", "label")},
    classes AS (SELECT cluster, CASE WHEN count(*) FILTER (label = 'normal.') > count(*) FILTER (label <> 'normal.') THEN 'normal'
      WHEN count(*) FILTER (label = 'normal.') < count(*) FILTER (label <> 'normal.') THEN 'attack' END AS cluster_class
      FROM second GROUP BY cluster)
    SELECT f.id, CASE WHEN f.d >= 0.8 THEN 'attack' ELSE cluster_class END AS judged
    FROM first f JOIN second s ON s.id = f.id JOIN classes c ON c.cluster = s.cluster""",
)
def cascade(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    normal = df.filter(F.col("label") == "normal.")
    first = kmeans.lloyd(normal, kmeans.first_rows(normal, 6, ["id"]), 2)
    second = kmeans.lloyd(df, kmeans.first_rows(df, 8, ["id"]), 2)
    counts = labelling.class_counts(second.assign(df), 8, F.col("label") == "normal.")
    both = first.assign(df, cluster="normal_cluster", distance="normal_distance")
    judged = labelling.attach_class(second.assign(both), labelling.majority(counts))
    name = threshold.cascade(F.col("normal_distance"), 0.8, F.col("cluster_class"))
    return judged.select("id", name.alias("judged"))


@query(
    "t8_outlier_degree",
    f"""WITH {SQL_EMBEDDINGS}, {SQL_TOPIC_CENTERS}
    SELECT p.id, {r(f"count(*) / sum({sq('p.x', 'c.x')})")} AS degree FROM pts p CROSS JOIN centers c GROUP BY p.id""",
)
def outlier_degree(spark, sf_dir):
    centers = topic_centers(spark, sf_dir).matrix
    degree = threshold.outlier_degree(F.col("features"), centers)
    return embeddings(spark, sf_dir).select("id", rounded(degree).alias("degree"))


@query("t9_accepted_ids", f"WITH {SQL_E_LLOYD} SELECT id FROM a WHERE d < 0.85")
def accepted_ids(spark, sf_dir):
    assigned = embedding_centers(spark, sf_dir).assign(embeddings(spark, sf_dir))
    return threshold.accepted_ids(assigned, F.col("sq_distance") < 0.85)
