"""Distances between rows, and from rows to centres."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from farpoint.catalog.base import SQL_EMBEDDINGS, SQL_LINES, SQL_TOPIC_CENTERS, embeddings, lines, query, r, rounded, sq
from farpoint.functions import vectors
from farpoint.operators import kmeans
from farpoint.operators.kmeans import Centers, sum_arrays


def topic_centers(spark, sf_dir) -> Centers:
    """Mean point of every topic: ten centres from the whole table."""
    df = embeddings(spark, sf_dir)
    sums = df.groupBy("topic").agg(F.count("*").alias("n"), sum_arrays(F.col("features")).alias("total"))
    means = sums.select(F.col("topic").alias("cluster"), F.transform("total", lambda v: v / F.col("n")).alias("center"))
    return kmeans.centers_from_table(means)


_PTS = f"WITH {SQL_EMBEDDINGS}, {SQL_TOPIC_CENTERS}"
_OWN = f"{_PTS} SELECT p.id, {{}} FROM pts p JOIN centers c ON c.cluster = p.topic"


def with_own_center(spark, sf_dir):
    centers = topic_centers(spark, sf_dir).table(spark)
    return embeddings(spark, sf_dir).join(F.broadcast(centers), F.col("topic") == F.col("cluster"))


@query("x1_squared_euclidean", _OWN.format(r(sq("p.x", "c.x")) + " AS d"))
def squared_euclidean(spark, sf_dir):
    d = vectors.squared_euclidean(F.col("features"), F.col("center"))
    return with_own_center(spark, sf_dir).select("id", rounded(d).alias("d"))


@query("x2_euclidean", _OWN.format(r(f"sqrt({sq('p.x', 'c.x')})") + " AS d"))
def euclidean(spark, sf_dir):
    d = vectors.euclidean(F.col("features"), F.col("center"))
    return with_own_center(spark, sf_dir).select("id", rounded(d).alias("d"))


@query(
    "x3_mixed_rms",
    f"""WITH {SQL_LINES}, pairs AS (
      SELECT id, lag(id) OVER w AS other, l_quantity - lag(l_quantity) OVER w AS dq, l_tax - lag(l_tax) OVER w AS dt,
        CASE WHEN l_returnflag = lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS f,
        CASE WHEN l_linestatus = lag(l_linestatus) OVER w THEN 0 ELSE 1 END AS s
      FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY id))
    SELECT id, other, {r("sqrt((dq * dq + dt * dt + f + s) / 4)")} AS d FROM pairs WHERE other IS NOT NULL""",
)
def mixed_rms(spark, sf_dir):
    """Every order line against the line before it in the same order."""
    window = Window.partitionBy("l_orderkey").orderBy("id")
    df = lines(spark, sf_dir).select(
        "l_orderkey",
        "id",
        F.array("l_quantity", "l_tax").alias("numbers"),
        F.array("l_returnflag", "l_linestatus").alias("words"),
    )
    df = df.withColumns({f"other_{c}": F.lag(c).over(window) for c in ("id", "numbers", "words")})
    pairs = df.filter(F.col("other_id").isNotNull())
    d = vectors.mixed_rms(F.col("numbers"), F.col("other_numbers"), F.col("words"), F.col("other_words"))
    return pairs.select("id", F.col("other_id").alias("other"), rounded(d).alias("d"))


@query("x4_distance_to_own_centroid", _OWN.format(f"c.cluster, {r('list_distance(p.x, c.x)')} AS d"))
def distance_to_own_centroid(spark, sf_dir):
    d = vectors.euclidean(F.col("features"), F.col("center"))
    return with_own_center(spark, sf_dir).select("id", "cluster", rounded(d).alias("d"))


def _spread(df):
    return df.select("id", F.posexplode("dists").alias("cluster", "d")).withColumn("d", rounded("d"))


@query("x5_distances_to_centers", f"{_PTS} SELECT p.id, c.cluster, {r(sq('p.x', 'c.x'))} AS d FROM pts p CROSS JOIN centers c")
def distances_to_centers(spark, sf_dir):
    return _spread(topic_centers(spark, sf_dir).distances(embeddings(spark, sf_dir)))


@query(
    "x5_plain_distances_to_centers",
    f"{_PTS} SELECT p.id, c.cluster, {r('list_distance(p.x, c.x)')} AS d FROM pts p CROSS JOIN centers c",
)
def plain_distances_to_centers(spark, sf_dir):
    return _spread(topic_centers(spark, sf_dir).distances(embeddings(spark, sf_dir), squared=False))


@query(
    "x6_total_distance",
    f"{_PTS} SELECT p.id, {r('sum(' + sq('p.x', 'c.x') + ')')} AS d FROM pts p CROSS JOIN centers c GROUP BY p.id",
)
def total_distance(spark, sf_dir):
    centers = topic_centers(spark, sf_dir).matrix
    d = vectors.total_center_distance(F.col("features"), centers)
    return embeddings(spark, sf_dir).select("id", rounded(d).alias("d"))


@query("x7_rbf_kernel", _OWN.format(r(f"exp(-0.5 * ({sq('p.x', 'c.x')}))") + " AS kernel"))
def rbf_kernel(spark, sf_dir):
    kernel = vectors.rbf(F.col("features"), F.col("center"), -0.5)
    return with_own_center(spark, sf_dir).select("id", rounded(kernel).alias("kernel"))
