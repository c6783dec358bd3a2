"""Local outlier factor: against centres, and exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import (
    SQL_EMBEDDINGS,
    SQL_TOPIC_CENTERS,
    embeddings,
    lines,
    query,
    r,
    rate_columns,
    rounded,
    scaled_lines,
    sql_assign,
    sql_lloyd,
    sql_outcome,
    sql_rates,
    table,
)
from farpoint.catalog.distances import topic_centers
from farpoint.operators import centroid_lof, evaluate, exact_lof, kmeans, neighbours, nested_neighbours, projected_neighbours, threshold
from farpoint.session import materialize

_K = 4


def sql_centroid_lof(points: str, centers: str, prefix: str, k: int, sizes: str | None) -> str:
    """Factor of every point against centres ``(cluster, x)``; ``sizes (cluster, n)``."""
    p = prefix
    weight = "s.n / sum(s.n) OVER (PARTITION BY q.id)" if sizes else "1"
    join = f"JOIN {sizes} s ON s.cluster = q.o" if sizes else ""
    return f"""{p}cc AS MATERIALIZED (SELECT a.cluster AS p, b.cluster AS o, list_distance(a.x, b.x) AS d,
      row_number() OVER (PARTITION BY a.cluster ORDER BY list_distance(a.x, b.x), b.cluster) AS n FROM {centers} a CROSS JOIN {centers} b),
    {p}kd AS (SELECT p AS cluster, max(d) AS kdist FROM {p}cc WHERE n <= {k} GROUP BY p),
    {p}cl AS MATERIALIZED (SELECT cc.p AS cluster, {k} / sum(greatest(cc.d, kd.kdist)) AS lrd
      FROM {p}cc cc JOIN {p}kd kd ON kd.cluster = cc.o WHERE n <= {k} GROUP BY cc.p),
    {p}pn AS MATERIALIZED (SELECT * FROM (SELECT t.id, c.cluster AS o, list_distance(t.x, c.x) AS d,
      row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.x, c.x), c.cluster) AS n FROM {points} t CROSS JOIN {centers} c) WHERE n <= {k}),
    {p}pl AS (SELECT q.id, max(q.d) AS kdist, {k} / sum(greatest(q.d, kd.kdist)) AS lrd
      FROM {p}pn q JOIN {p}kd kd ON kd.cluster = q.o GROUP BY q.id),
    {p}lof AS MATERIALIZED (SELECT id, any_value(kdist) AS kdist, any_value(lrd) AS lrd, sum(w * other / lrd) / {k} AS lof FROM (
      SELECT q.id, l.kdist, l.lrd, c.lrd AS other, {weight} AS w
      FROM {p}pn q JOIN {p}pl l ON l.id = q.id JOIN {p}cl c ON c.cluster = q.o {join}) GROUP BY id)"""


_TOPIC_SIZES = f"{sql_assign('a', 'pts', 'centers', 'label')}, sizes AS (SELECT cluster, count(*) AS n FROM a GROUP BY cluster)"
_PLAIN = f"WITH {SQL_EMBEDDINGS}, {SQL_TOPIC_CENTERS}, {sql_centroid_lof('pts', 'centers', 'f', _K, None)}"
_WEIGHTED = f"WITH {SQL_EMBEDDINGS}, {SQL_TOPIC_CENTERS}, {_TOPIC_SIZES}, {sql_centroid_lof('pts', 'centers', 'f', _K, 'sizes')}"


def topic_lof(spark, sf_dir, weighted=False):
    centers, sizes = topic_centers(spark, sf_dir), None
    if weighted:
        sizes = centroid_lof.sizes_vector(kmeans.cluster_sizes(centers.assign(embeddings(spark, sf_dir))), centers.k)
    return centroid_lof.fit(centers.matrix, _K, sizes).score(embeddings(spark, sf_dir))


@query(
    "l1_k_nearest_centers",
    f"{_PLAIN} SELECT id, n::INTEGER AS place, o AS cluster, {r('d')} AS d, {r('max(d) OVER (PARTITION BY id)')} AS kdist FROM fpn",
)
def k_nearest_centers(spark, sf_dir):
    centers = topic_centers(spark, sf_dir)
    df = centers.distances(topic_lof(spark, sf_dir), squared=False)
    near = df.select("id", "kdist", "dists", F.posexplode("neighbours").alias("place", "cluster"))
    return near.select(
        "id",
        (F.col("place") + 1).alias("place"),
        "cluster",
        rounded(F.element_at("dists", F.col("cluster") + 1)).alias("d"),
        rounded("kdist").alias("kdist"),
    )


@query(
    "l2_reachability",
    f"{_PLAIN} SELECT q.id, q.o AS cluster, {r('greatest(q.d, kd.kdist)')} AS reach FROM fpn q JOIN fkd kd ON kd.cluster = q.o",
)
def reachability(spark, sf_dir):
    """Reachability distance of every row from its nearest centres."""
    centers = topic_centers(spark, sf_dir)
    model = centroid_lof.fit(centers.matrix, _K)
    kdist = F.array(*[F.lit(float(v)) for v in model.kdist])
    df = centers.distances(model.score(embeddings(spark, sf_dir)), squared=False)
    near = df.select("id", "dists", F.explode("neighbours").alias("cluster"))
    at = F.col("cluster") + 1
    reach = F.greatest(F.element_at("dists", at), F.element_at(kdist, at))
    return near.select("id", "cluster", rounded(reach).alias("reach"))


@query("l3_reachability_density", f"{_PLAIN} SELECT id, {r('lrd')} AS lrd FROM fpl")
def reachability_density(spark, sf_dir):
    return topic_lof(spark, sf_dir).select("id", rounded("lrd").alias("lrd"))


@query("l4_centroid_lof", f"{_PLAIN} SELECT id, {r('lof')} AS lof FROM flof")
def centroid_factor(spark, sf_dir):
    return topic_lof(spark, sf_dir).select("id", rounded("lof").alias("lof"))


@query("l5_weighted_centroid_lof", f"{_WEIGHTED} SELECT id, {r('lof')} AS lof FROM flof")
def weighted_centroid_factor(spark, sf_dir):
    return topic_lof(spark, sf_dir, weighted=True).select("id", rounded("lof").alias("lof"))


@query(
    "l6_lof_detector",
    f"""{_WEIGHTED}, cut AS (SELECT max(lof) AS t FROM (SELECT lof, row_number() OVER (ORDER BY lof) AS n FROM flof)
      WHERE n <= (SELECT count(*) FROM flof) * 90 // 100),
    judged AS (SELECT f.id, CASE WHEN lof = t THEN 'noclass' ELSE {sql_outcome("label = 'normal.'", "lof < t")} END AS outcome
      FROM flof f JOIN pts p ON p.id = f.id, cut) {sql_rates("judged")}""",
)
def lof_detector(spark, sf_dir):
    scored = materialize(topic_lof(spark, sf_dir, weighted=True), "lof")
    cut = threshold.percent_position(scored, "lof", 90)
    judged = evaluate.judged_by_score(F.col("lof"), cut)
    result = scored.withColumn("outcome", evaluate.outcome(F.col("label") == "normal.", judged))
    return rate_columns(evaluate.rates(evaluate.confusion(result)))


def _sql_stage(points: str, p: str) -> str:
    """Centres, sizes, factors and the cut at the top 10 % of one stage."""
    return f"""{sql_lloyd(points, 8, 2, p + "c")}, {sql_assign(p + "a", points, p + "c2")},
    {p}s AS (SELECT c.cluster, count(a.id) AS n FROM {p}c2 c LEFT JOIN {p}a a ON a.cluster = c.cluster GROUP BY c.cluster),
    {sql_centroid_lof(points, p + "c2", p, _K, p + "s")},
    {p}t AS (SELECT round(min(lof), 9) AS t FROM (SELECT lof, row_number() OVER (ORDER BY lof DESC) AS n FROM {p}lof)
      WHERE n <= (SELECT count(*) FROM {p}lof) * 10 // 100)"""


_NORMAL_HALF = "SELECT * FROM pts WHERE label = 'normal.' AND id % 2 = {}"


@query(
    "l7_two_stage_lof",
    f"""WITH {SQL_EMBEDDINGS}, h1 AS ({_NORMAL_HALF.format(0)}), h2 AS ({_NORMAL_HALF.format(1)}), {_sql_stage("h1", "u")},
    {sql_centroid_lof("h2", "uc2", "v", _K, "us")},
    kept AS MATERIALIZED (SELECT h2.* FROM h2 JOIN vlof ON vlof.id = h2.id, ut WHERE round(lof, 9) < t), {_sql_stage("kept", "w")},
    {sql_centroid_lof("pts", "wc2", "z", _K, "ws")},
    judged AS (SELECT f.id, CASE WHEN round(lof, 9) = t THEN 'noclass' ELSE {sql_outcome("label = 'normal.'", "round(lof, 9) < t")} END AS outcome
      FROM zlof f JOIN pts p ON p.id = f.id, wt) {sql_rates("judged")}""",
)
def two_stage_lof(spark, sf_dir):
    """Both halves of the normal rows train; all rows are judged.  Factors are compared
    after rounding, since one row lies exactly on the threshold."""
    df = embeddings(spark, sf_dir)
    normal = df.filter(F.col("label") == "normal.")

    def score(model, rows):
        return model.score(rows).withColumn("lof", rounded("lof", 9))

    def stage(rows):
        centers = kmeans.lloyd(rows, kmeans.first_rows(rows, 8, ["id"]), 2)
        sizes = centroid_lof.sizes_vector(kmeans.cluster_sizes(centers.assign(rows)), 8)
        model = centroid_lof.fit(centers.matrix, _K, sizes)
        scores = materialize(score(model, rows).select("lof"), "stage")
        return model, threshold.percent_position(scores, "lof", 10, ascending=False)

    model, cut = stage(normal.filter("id % 2 = 0"))
    kept = materialize(score(model, normal.filter("id % 2 = 1")).filter(F.col("lof") < cut).select("id", "features"), "kept")
    model, cut = stage(kept)
    judged = evaluate.judged_by_score(F.col("lof"), cut)
    result = score(model, df).withColumn("outcome", evaluate.outcome(F.col("label") == "normal.", judged))
    return rate_columns(evaluate.rates(evaluate.confusion(result)))


# --- exact -------------------------------------------------------------------


def sql_exact_lof(pairs: str, kept: str, k_distance: str) -> str:
    """Leave-one-out factor from ``pairs (p, o, d, w)``: ``kept`` is the filter that makes a
    neighbourhood of the numbered pairs, ``k_distance`` the aggregate that gives kdist."""
    return f"""{pairs},
    numbered AS (SELECT *, dense_rank() OVER (PARTITION BY p ORDER BY d) AS dr,
      coalesce(sum(w) OVER (PARTITION BY p ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0)
        AS closer,
      row_number() OVER (PARTITION BY p, d ORDER BY o) AS place FROM pairs),
    hood AS MATERIALIZED (SELECT p, o, d, w FROM ({kept})),
    kd AS MATERIALIZED (SELECT p, {k_distance} AS kdist FROM hood GROUP BY p),
    dens AS MATERIALIZED (SELECT h.p, CASE WHEN sum(w * greatest(h.d, kd.kdist)) > 0
        THEN sum(w) / sum(w * greatest(h.d, kd.kdist)) ELSE 'infinity'::DOUBLE END AS lrd
      FROM hood h JOIN kd ON kd.p = h.o GROUP BY h.p),
    factor AS MATERIALIZED (SELECT h.p, sum(w * CASE WHEN isinf(o.lrd) AND isinf(m.lrd) THEN 1 ELSE o.lrd / m.lrd END) / sum(w) AS lof
      FROM hood h JOIN dens m ON m.p = h.p JOIN dens o ON o.p = h.o GROUP BY h.p)"""


_STANDARD = "SELECT * FROM numbered WHERE closer < {k}"
_DISTINCT = "SELECT * FROM numbered WHERE dr <= {k}"
_HEAP = "SELECT p, o, d, 1 AS w FROM numbered WHERE closer < {k} AND place = 1"

_E_PAIRS = """pairs AS MATERIALIZED (SELECT a.id AS p, b.id AS o, list_distance(a.x, b.x) AS d, 1 AS w
  FROM pts a JOIN pts b ON a.id <> b.id)"""


@query(
    "l8_exact_lof_embeddings",
    f"WITH {SQL_EMBEDDINGS}, {sql_exact_lof(_E_PAIRS, _STANDARD.format(k=5), 'max(d)')} SELECT p AS id, {r('lof')} AS lof FROM factor",
)
def exact_lof_embeddings(spark, sf_dir):
    model = exact_lof.fit(embeddings(spark, sf_dir), 5)
    return model.train_scores.select("id", rounded("lof").alias("lof"))


def records(spark, sf_dir):
    """Parts as records of two numbers and two strings; the numbers are binary fractions, so that ties are exact."""
    df = table(spark, sf_dir, "part")
    numbers = F.array(F.col("p_size") / 8, F.floor(F.col("p_retailprice") / 5) / 128)
    return df.select(F.col("p_partkey").alias("id"), F.struct(numbers.alias("num"), F.array("p_brand", "p_type").alias("str")).alias("features"))


_RECORDS = """points AS MATERIALIZED (SELECT min(p_partkey) AS p, count(*) AS w, p_size / 8 AS a, floor(p_retailprice / 5) / 128 AS b,
  p_brand AS c, p_type AS e FROM part GROUP BY p_size, floor(p_retailprice / 5) / 128, p_brand, p_type),
pairs AS MATERIALIZED (SELECT x.p, y.p AS o, y.w - (x.p = y.p)::INT AS w,
  sqrt(((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c <> y.c)::INT + (x.e <> y.e)::INT) / 4) AS d
  FROM points x CROSS JOIN points y WHERE x.p <> y.p OR y.w > 1)"""


def _sql_records(rule: str) -> str:
    return f"""WITH {sql_exact_lof(_RECORDS, rule, 'max(d)')} SELECT r.p_partkey AS id, {r('f.lof')} AS lof
    FROM part r JOIN points q ON q.a = p_size / 8 AND q.b = floor(p_retailprice / 5) / 128 AND q.c = p_brand AND q.e = p_type
    JOIN factor f ON f.p = q.p"""


def _records_lof(spark, sf_dir, rule):
    model = exact_lof.fit(records(spark, sf_dir), 5, rule, metric=nested_neighbours.Mixed(), block_rows=256)
    return model.train_scores.select("id", rounded("lof").alias("lof"))


@query("l8_exact_lof_records", _sql_records(_STANDARD.format(k=5)))
def exact_lof_records(spark, sf_dir):
    """Records of numbers and strings under the mixed distance."""
    return _records_lof(spark, sf_dir, "standard")


@query("l9_ties_kept_records", _sql_records(_DISTINCT.format(k=5)))
def ties_kept_records(spark, sf_dir):
    return _records_lof(spark, sf_dir, "distinct")


@query("l10_one_neighbour_per_distance_records", _sql_records(_HEAP.format(k=5)))
def one_neighbour_per_distance_records(spark, sf_dir):
    return _records_lof(spark, sf_dir, "heap")


@query("l8_exact_lof_lines")
def exact_lof_lines(spark, sf_dir):
    """Four scaled numbers of every order line; the all-pairs SQL would be too slow."""
    model = exact_lof.fit(scaled_lines(spark, sf_dir), 5)
    return model.train_scores.select("id", "label", rounded("lof").alias("lof"))


@query("l8_projected_lof_lines")
def projected_lof_lines(spark, sf_dir):
    """The approximate factor of every order line; ``proven`` marks rows whose neighbours are certainly exact."""
    model = exact_lof.fit(scaled_lines(spark, sf_dir), 5, forest=projected_neighbours.Forest())
    return model.train_scores.select("id", "label", rounded("lof").alias("lof"), "proven")


@query("l8_projected_recall_lines")
def projected_recall_lines(spark, sf_dir):
    """The approximate neighbourhoods of all different order lines against the exact ones: the mean share found,
    points of which less than 0.9 is found, points with a proof, and such points that lack a neighbour."""
    points = materialize(neighbours.distinct_points(scaled_lines(spark, sf_dir), None), "points")
    points = points.withColumn("weight", F.lit(1.0))
    asked = points.withColumn("need", F.lit(5.0))
    found, proofs = projected_neighbours.grow(points, projected_neighbours.Forest()).pairs(asked, 5)
    exact = nested_neighbours.candidate_pairs(asked, points, 5)
    shares = projected_neighbours.recall(neighbours.neighbourhood(found, 5), neighbours.neighbourhood(exact, 5))
    return shares.join(proofs, "pid").agg(
        F.count("*").alias("points"),
        rounded(F.avg("recall"), 4).alias("recall"),
        F.count_if(F.col("recall") < 0.9).alias("under"),
        F.count_if("proven").alias("proven"),
        F.count_if(F.col("proven") & (F.col("recall") < 1)).alias("proven_lacking"),
    )


_NUMBERS = """points AS MATERIALIZED (SELECT min(p_partkey) AS p, count(*) AS w, p_size / 8 AS a, floor(p_retailprice / 5) / 128 AS b
  FROM part GROUP BY p_size, floor(p_retailprice / 5) / 128),
pairs AS MATERIALIZED (SELECT x.p, y.p AS o, y.w - (x.p = y.p)::INT AS w, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d
  FROM points x CROSS JOIN points y WHERE x.p <> y.p OR y.w > 1)"""


@query(
    "l8_completed_lof_parts",
    f"""WITH {sql_exact_lof(_NUMBERS, _STANDARD.format(k=5), 'max(d)')} SELECT r.p_partkey AS id, {r('f.lof')} AS lof, true AS proven
    FROM part r JOIN points q ON q.a = p_size / 8 AND q.b = floor(p_retailprice / 5) / 128 JOIN factor f ON f.p = q.p""",
)
def completed_lof_parts(spark, sf_dir):
    """Projections first, the exact search for the points that they leave without proof."""
    df = records(spark, sf_dir).select("id", F.col("features.num").alias("features"))
    model = exact_lof.fit(df, 5, block_rows=256, forest=projected_neighbours.Forest(4, complete=True))
    return model.train_scores.select("id", rounded("lof").alias("lof"), "proven")


def lattice(spark, sf_dir):
    """Quantity and line number of every order line: 350 points with many copies and ties."""
    return lines(spark, sf_dir).select("id", F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double")).alias("features"))


_LATTICE = """rows AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity AS q, l_linenumber AS l FROM lineitem),
points AS MATERIALIZED (SELECT q, l, min(id) AS p, count(*) AS w FROM rows GROUP BY q, l),
{pairs}"""
_ALL_ROWS = """pairs AS MATERIALIZED (SELECT a.p, b.p AS o, sqrt((a.q - b.q) * (a.q - b.q) + (a.l - b.l) * (a.l - b.l)) AS d,
  b.w - CASE WHEN a.p = b.p THEN 1 ELSE 0 END AS w FROM points a CROSS JOIN points b WHERE a.p <> b.p OR b.w > 1)"""
_ONE_EACH = """pairs AS MATERIALIZED (SELECT a.p, b.p AS o, sqrt((a.q - b.q) * (a.q - b.q) + (a.l - b.l) * (a.l - b.l)) AS d,
  1 AS w FROM points a JOIN points b ON a.p <> b.p)"""
_BACK = f"SELECT r.id, {r('f.lof')} AS lof FROM rows r JOIN points USING (q, l) JOIN factor f ON f.p = points.p"


def _lattice_lof(spark, sf_dir, k, rule):
    model = exact_lof.fit(lattice(spark, sf_dir), k, rule)
    return model.train_scores.select("id", rounded("lof").alias("lof"))


@query(
    "l9_ties_kept",
    f"WITH {_LATTICE.format(pairs=sql_exact_lof(_ALL_ROWS, _DISTINCT.format(k=3), 'max(d)'))} {_BACK}",
)
def ties_kept(spark, sf_dir):
    return _lattice_lof(spark, sf_dir, 3, "distinct")


@query(
    "l10_one_neighbour_per_distance",
    f"WITH {_LATTICE.format(pairs=sql_exact_lof(_ALL_ROWS, _HEAP.format(k=600), 'max(d)'))} {_BACK}",
)
def one_neighbour_per_distance(spark, sf_dir):
    return _lattice_lof(spark, sf_dir, 600, "heap")


@query(
    "l10_ties_at_k_distance",
    f"WITH {_LATTICE.format(pairs=sql_exact_lof(_ALL_ROWS, _STANDARD.format(k=600), 'max(d)'))} {_BACK}",
)
def ties_at_k_distance(spark, sf_dir):
    """Standard neighbourhoods wider than one point's copies."""
    return _lattice_lof(spark, sf_dir, 600, "standard")


@query(
    "l11_collapsed_copies",
    f"WITH {_LATTICE.format(pairs=sql_exact_lof(_ONE_EACH, _STANDARD.format(k=4), 'max(d)'))} SELECT p AS id, {r('lof')} AS lof FROM factor",
)
def collapsed_copies(spark, sf_dir):
    """Leave-one-out with every distinct point counted once."""
    points = neighbours.distinct_points(lattice(spark, sf_dir))
    single = materialize(points.select(F.col("pid").alias("id"), F.col("x").alias("features")), "single")
    return exact_lof.fit(single, 4).train_scores.select("id", rounded("lof").alias("lof"))


@query(
    "l12_lof_report",
    f"""WITH {SQL_EMBEDDINGS}, {sql_exact_lof(_E_PAIRS, _DISTINCT.format(k=5), 'max(d)')},
    cut AS (SELECT lof AS t FROM (SELECT lof, row_number() OVER (ORDER BY lof DESC) - 1 AS n FROM factor)
      WHERE n = 2 * (SELECT count(*) FROM factor) // 100)
    SELECT p AS id, {r('lof')} AS lof, lof > t AS outlier FROM factor, cut ORDER BY factor.lof DESC, p""",
)
def lof_report(spark, sf_dir):
    """Rows by falling factor with a flag over the 2 % mark."""
    scores = materialize(exact_lof.fit(embeddings(spark, sf_dir), 5, "distinct").train_scores, "scores")
    return exact_lof.report(scores, scores).select("id", rounded("lof").alias("lof"), "outlier")
