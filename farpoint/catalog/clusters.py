"""k-means, cluster labels, two-level clustering, choice of k."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import (
    SQL_EMBEDDINGS,
    SQL_SCALED,
    SQL_TOPIC_CENTERS,
    VECTORS,
    embeddings,
    query,
    r,
    round_columns,
    rounded,
    scaled_lines,
    sq,
    sq4,
    sql_assign,
    sql_lloyd,
    table,
)
from farpoint.catalog.distances import topic_centers
from farpoint.operators import kmeans, labelling
from farpoint.plans.detectors import fit_two_level
from farpoint.session import materialize, spread
from farpoint.sources.records import split_by_modulus

E_K, E_ROUNDS = 8, 3
L_K, L_ROUNDS = 5, 4

_TOPIC = f"WITH {SQL_EMBEDDINGS}, {SQL_TOPIC_CENTERS}, {sql_assign('a', 'pts', 'centers', 'topic, label')}"
SQL_E_LLOYD = f"{SQL_EMBEDDINGS}, {sql_lloyd('pts', E_K, E_ROUNDS)}, {sql_assign('a', 'pts', f'c{E_ROUNDS}', 'topic, label')}"
SQL_L_LLOYD = f"{SQL_SCALED}, {sql_lloyd('pts', L_K, L_ROUNDS, distance=sq4)}, {sql_assign('a', 'pts', f'c{L_ROUNDS}', 'label', sq4)}"


def embedding_centers(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return kmeans.lloyd(df, kmeans.first_rows(df, E_K, ["id"]), E_ROUNDS)


def line_centers(df):
    return kmeans.lloyd(df, kmeans.first_rows(df, L_K, ["id"]), L_ROUNDS)


def stored_lines(spark, sf_dir):
    """Scaled rows, stored once because several passes read them."""
    return materialize(spread(scaled_lines(spark, sf_dir)), "scaled-lines")


def _by_topic(spark, sf_dir):
    return topic_centers(spark, sf_dir).assign(embeddings(spark, sf_dir))


# --- training and assignment -------------------------------------------------


@query("k1_lloyd_embeddings", f"WITH {SQL_E_LLOYD} SELECT id, cluster::INTEGER AS cluster, {r('d')} AS d FROM a")
def lloyd_embeddings(spark, sf_dir):
    assigned = embedding_centers(spark, sf_dir).assign(embeddings(spark, sf_dir))
    return assigned.select("id", "cluster", rounded("sq_distance").alias("d"))


@query("k1_lloyd_lines", f"WITH {SQL_L_LLOYD} SELECT id, cluster::INTEGER AS cluster, {r('d')} AS d FROM a")
def lloyd_lines(spark, sf_dir):
    df = stored_lines(spark, sf_dir)
    return line_centers(df).assign(df).select("id", "cluster", rounded("sq_distance").alias("d"))


@query("k1_library_lines")
def library_lines(spark, sf_dir):
    """Spark ML k-means on the scaled lines: size and mean distance per cluster."""
    # not the stored rows: a scan packs their files into large tasks, and a task's rows are kept in memory
    df = spread(scaled_lines(spark, sf_dir).select("features"))
    assigned = kmeans.train(df, 20, 10).assign(df)
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.sqrt("sq_distance")).alias("mean_distance"))


def _share(run: str, step: int) -> str:
    return f"('0x' || substr(md5({run} || '-{step}-' || id), 1, 8))::BIGINT / 4294967296.0"


def _sql_nearest(name: str, centers: str, distance) -> str:
    """``(run, id, x, cluster, d)``: every point with the nearest centre of every run."""
    return f"""{name} AS MATERIALIZED (SELECT c.run, p.id, any_value(p.x) AS x, arg_min(c.cluster, {distance("p.x", "c.x")}) AS cluster,
      min({distance("p.x", "c.x")}) AS d FROM pts p CROSS JOIN {centers} c GROUP BY c.run, p.id)"""


def sql_random_seeds(k: int, runs: int, name: str = "s") -> str:
    return f"""runs AS (SELECT unnest(range(1, {runs + 1})) AS run),
    {name} AS MATERIALIZED (SELECT run, row_number() OVER (PARTITION BY run ORDER BY md5(run || '-0-' || id)) - 1 AS cluster, id, x
      FROM pts CROSS JOIN runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY md5(run || '-0-' || id)) <= {k})"""


def sql_parallel_seeds(k: int, runs: int, steps: int, distance) -> str:
    """Seeds ``s`` by k-means||: as many steps of draws, weights, then one taken after the other."""
    parts = [sql_random_seeds(1, runs, "b0")]
    for i in range(1, steps + 1):
        parts.append(_sql_nearest(f"bn{i}", f"b{i - 1}", distance))
        parts.append(f"""b{i} AS MATERIALIZED (SELECT * FROM b{i - 1} UNION ALL
          SELECT run, {1000 * i} + row_number() OVER (PARTITION BY run ORDER BY id) AS cluster, id, x
          FROM (SELECT *, sum(d) OVER (PARTITION BY run) AS cost FROM bn{i}) WHERE {_share("run", i)} * cost < {2.0 * k} * d)""")
    parts.append(_sql_nearest("bw", f"b{steps}", distance))
    parts.append(f"""drawn AS MATERIALIZED (SELECT b.*, (SELECT count(*) FROM bw WHERE bw.run = b.run AND bw.cluster = b.cluster) AS w
      FROM b{steps} b)""")
    worth, taken = "w", ""
    for i in range(k):
        if i:
            taken = f", min({distance('b.x', 't.x')}) AS apart FROM drawn b JOIN t{i - 1} t ON t.run = b.run GROUP BY ALL"
            worth = "w * apart"
        parts.append(f"""t{i} AS MATERIALIZED ({f"SELECT * FROM t{i - 1} UNION ALL" if i else ""} SELECT run, {i} AS cluster, id, x
          FROM (SELECT b.run, b.cluster, b.id, b.x, b.w {taken or "FROM drawn b"})
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY {worth} DESC, cluster) = 1)""")
    parts.append(f"s AS (SELECT * FROM t{k - 1})")
    return ", ".join(parts)


def sql_runs(k: int, iterations: int, distance) -> str:
    """Lloyd from the seeds ``s`` of all runs; ``best (run)`` has the least cost, ``a`` its rows and ``c`` its centres."""
    parts = ["r0 AS (SELECT run, cluster, x FROM s)"]
    for i in range(iterations):
        parts.append(_sql_nearest(f"ra{i}", f"r{i}", distance))
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT o.run, o.cluster, coalesce(m.x, o.x) AS x FROM r{i} o LEFT JOIN (
          SELECT run, cluster, list(v ORDER BY pos) AS x FROM (SELECT run, cluster, pos, avg(v) AS v
            FROM (SELECT run, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM ra{i}) GROUP BY run, cluster, pos)
          GROUP BY run, cluster) m ON m.run = o.run AND m.cluster = o.cluster)""")
    parts.append(_sql_nearest("ra", f"r{iterations}", distance))
    parts.append("best AS (SELECT run FROM ra GROUP BY run ORDER BY round(sum(d), 6), run LIMIT 1)")
    parts.append("a AS (SELECT * FROM ra WHERE run = (SELECT run FROM best))")
    parts.append(f"c AS (SELECT * FROM r{iterations} WHERE run = (SELECT run FROM best))")
    return ", ".join(parts)


_R_K, _R_RUNS, _R_ROUNDS = 8, 4, 5


@query(
    "k2_restarts",
    f"""WITH {SQL_EMBEDDINGS}, {sql_parallel_seeds(_R_K, _R_RUNS, 2, sq)}, {sql_runs(_R_K, _R_ROUNDS, sq)}
    SELECT cluster::INTEGER AS cluster, count(*) AS n FROM a GROUP BY cluster""",
)
def restarts(spark, sf_dir):
    """Four starts by k-means||, fitted in the same scans; sizes of the best."""
    df = spread(embeddings(spark, sf_dir))
    models = kmeans.train_together(df, [_R_K] * _R_RUNS, ["id"], _R_ROUNDS)
    return kmeans.cluster_sizes(kmeans.best_of(models).assign(df))


@query(
    "k3_random_start",
    f"""WITH {SQL_EMBEDDINGS}, {sql_random_seeds(_R_K, _R_RUNS)}, {sql_runs(_R_K, _R_ROUNDS, sq)}
    SELECT cluster::INTEGER AS cluster, count(*) AS n FROM a GROUP BY cluster""",
)
def random_start(spark, sf_dir):
    df = spread(embeddings(spark, sf_dir))
    models = kmeans.train_together(df, [_R_K] * _R_RUNS, ["id"], _R_ROUNDS, init="random")
    return kmeans.cluster_sizes(kmeans.best_of(models).assign(df))


@query(
    "k4_default_two_clusters",
    f"""WITH {SQL_SCALED}, {sql_parallel_seeds(2, 1, 2, sq4)}, {sql_runs(2, 20, sq4)}
    SELECT cluster::INTEGER AS cluster, {", ".join(f"{r(f'x[{i}]', 4)} AS x{i}" for i in range(1, 5))} FROM c""",
)
def default_two_clusters(spark, sf_dir):
    """Two clusters and their centres."""
    [model] = kmeans.train_together(stored_lines(spark, sf_dir), [2], ["id"])
    return model.table(spark).select("cluster", *[rounded(F.col("center")[i - 1], 4).alias(f"x{i}") for i in range(1, 5)])


@query("k5_assign", f"{_TOPIC} SELECT id, cluster, {r('d')} AS d FROM a")
def assign(spark, sf_dir):
    return _by_topic(spark, sf_dir).select("id", "cluster", rounded("sq_distance").alias("d"))


@query(
    "k6_centroid_table",
    f"""WITH {SQL_L_LLOYD} SELECT cluster::INTEGER AS cluster, {", ".join(f"{r(f'x[{i}]')} AS x{i}" for i in range(1, 5))}
    FROM c{L_ROUNDS}""",
)
def centroid_table(spark, sf_dir):
    centers = line_centers(stored_lines(spark, sf_dir)).table(spark)
    return centers.select("cluster", *[rounded(F.col("center")[i - 1]).alias(f"x{i}") for i in range(1, 5)])


@query("k7_points_per_cluster", f"{_TOPIC} SELECT cluster, count(*) AS n FROM a GROUP BY cluster")
def points_per_cluster(spark, sf_dir):
    return kmeans.cluster_sizes(_by_topic(spark, sf_dir))


@query("k8_cluster_label_counts", f"{_TOPIC} SELECT cluster, label, count(*) AS n FROM a GROUP BY cluster, label")
def cluster_label_counts(spark, sf_dir):
    return kmeans.label_counts(_by_topic(spark, sf_dir)).withColumnRenamed("count", "n")


# --- labels of clusters ------------------------------------------------------

_COUNTS = f"""WITH {SQL_L_LLOYD}, counts AS (
  SELECT k.cluster, count(a.id) FILTER (a.label = 'normal.') AS normal, count(a.id) FILTER (a.label <> 'normal.') AS attack
  FROM (SELECT unnest(range({L_K + 2}))::INTEGER AS cluster) k LEFT JOIN a ON a.cluster = k.cluster GROUP BY k.cluster)"""


def line_counts(spark, sf_dir):
    """Class counts for the ids of all clusters and of two that stay empty."""
    df = stored_lines(spark, sf_dir)
    return labelling.class_counts(line_centers(df).assign(df), L_K + 2, F.col("label") == "normal.")


@query("k9_class_counts", f"{_COUNTS} SELECT cluster, normal, attack FROM counts")
def class_counts(spark, sf_dir):
    return line_counts(spark, sf_dir)


@query(
    "k10_majority_class",
    f"""{_COUNTS} SELECT cluster, CASE WHEN normal > attack THEN 'normal' WHEN attack > normal THEN 'attack' END
    AS cluster_class FROM counts""",
)
def majority_class(spark, sf_dir):
    return labelling.majority(line_counts(spark, sf_dir)).select("cluster", "cluster_class")


@query(
    "k11_impure_clusters",
    f"""{_COUNTS} SELECT cluster, normal, attack FROM counts
    WHERE (normal + attack > 0 AND normal::DOUBLE / (normal + attack) > 0.3 AND normal::DOUBLE / (normal + attack) < 0.7)
       OR cluster = 0""",
)
def impure_clusters(spark, sf_dir):
    return labelling.impure(line_counts(spark, sf_dir), 0.3, 0.7, force=[0])


# --- two levels --------------------------------------------------------------

_T_K, _T_ROUNDS, _S_ROUNDS = 4, 2, 3


def _sql_two_level():
    parts = [
        SQL_SCALED,
        sql_lloyd("pts", _T_K, _T_ROUNDS, distance=sq4),
        sql_assign("a", "pts", f"c{_T_ROUNDS}", "label", sq4),
        f"""impure AS (SELECT cluster FROM (SELECT cluster, count(*) FILTER (label = 'normal.')::DOUBLE / count(*) AS s
            FROM a GROUP BY cluster) WHERE s > 0.2 AND s < 0.8)""",
        """s0 AS MATERIALIZED (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS sub, x
            FROM a WHERE cluster IN (SELECT cluster FROM impure)
            QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY id) <= 2)""",
    ]
    for i in range(_S_ROUNDS + 1):
        last = i == _S_ROUNDS
        parts.append(
            f"""b{i} AS MATERIALIZED (SELECT a.id, any_value(a.x) AS x, any_value(a.label) AS label, any_value(a.cluster) AS cluster,
                 arg_min(s.sub, {sq4("a.x", "s.x")}) AS sub FROM a JOIN s{i} s ON s.cluster = a.cluster GROUP BY a.id)"""
        )
        if not last:
            parts.append(
                f"""s{i + 1} AS MATERIALIZED (SELECT o.cluster, o.sub, coalesce(m.x, o.x) AS x FROM s{i} o LEFT JOIN (
                  SELECT cluster, sub, list(v ORDER BY pos) AS x FROM (SELECT cluster, sub, pos, avg(v) AS v FROM (
                    SELECT cluster, sub, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM b{i})
                    GROUP BY cluster, sub, pos) GROUP BY cluster, sub) m ON m.cluster = o.cluster AND m.sub = o.sub)"""
            )
    return "WITH " + ",\n".join(parts)


_TWO = _sql_two_level()


def two_level(spark, sf_dir):
    df = stored_lines(spark, sf_dir)
    centers = kmeans.lloyd(df, kmeans.first_rows(df, _T_K, ["id"]), _T_ROUNDS)
    model, top = fit_two_level(df, centers, VECTORS, 2, _S_ROUNDS)
    return df, model, top


@query(
    "k12_second_level_centers",
    f"""{_TWO} SELECT cluster::INTEGER AS cluster, sub::INTEGER AS sub,
    {", ".join(f"{r(f'x[{i}]')} AS x{i}" for i in range(1, 5))} FROM s{_S_ROUNDS}""",
)
def second_level_centers(spark, sf_dir):
    _, model, _ = two_level(spark, sf_dir)
    return model.sub_table(spark).select(
        "cluster", "sub", *[rounded(F.col("center")[i - 1]).alias(f"x{i}") for i in range(1, 5)]
    )


@query(
    "k13_sub_cluster_classes",
    f"""{_TWO} SELECT cluster::INTEGER AS cluster, sub::INTEGER AS sub, normal, attack,
      CASE WHEN normal > attack THEN 'normal' WHEN attack > normal THEN 'attack' END AS cluster_class
    FROM (SELECT cluster, sub, count(*) FILTER (label = 'normal.') AS normal, count(*) FILTER (label <> 'normal.') AS attack
          FROM b{_S_ROUNDS} GROUP BY cluster, sub)""",
)
def sub_cluster_classes(spark, sf_dir):
    df, model, _ = two_level(spark, sf_dir)
    return labelling.sub_classes(model.assign(df), F.col("label") == "normal.")


@query(
    "k14_two_level_assignment",
    f"""{_TWO} SELECT a.id, a.cluster::INTEGER AS cluster, b.sub::INTEGER AS sub FROM a LEFT JOIN b{_S_ROUNDS} b ON b.id = a.id""",
)
def two_level_assignment(spark, sf_dir):
    df, model, _ = two_level(spark, sf_dir)
    return model.assign(df).select("id", "cluster", "sub")


# --- quality and choice of k -------------------------------------------------


@query("k15_within_cost", f"WITH {SQL_L_LLOYD} SELECT {r('sum(d)', 4)} AS wssse FROM a")
def within_cost(spark, sf_dir):
    df = stored_lines(spark, sf_dir)
    return round_columns(kmeans.within_cost(line_centers(df).assign(df)), ["wssse"], 4)


@query("k16_mean_distance", f"WITH {SQL_L_LLOYD} SELECT {r('avg(sqrt(d))')} AS score FROM a")
def mean_distance(spark, sf_dir):
    df = stored_lines(spark, sf_dir)
    return round_columns(kmeans.mean_distance(line_centers(df).assign(df)), ["score"])


_ENTROPY = """SELECT sum(n * h) / sum(n) FROM (SELECT sum(c) AS n, -sum(c / t * ln(c / t)) AS h FROM (
  SELECT cluster, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY cluster) AS t FROM {} GROUP BY cluster, {}) GROUP BY cluster)"""


@query("k17_label_entropy", f"{_TOPIC} SELECT {r('(' + _ENTROPY.format('a', 'topic') + ')')} AS score")
def label_entropy(spark, sf_dir):
    return round_columns(kmeans.mean_entropy(_by_topic(spark, sf_dir), label="topic"), ["score"])


_KS = (2, 4, 6, 8)


def _sql_sweep(score):
    parts, tables = [SQL_SCALED], []
    for k in _KS:
        parts.append(sql_lloyd("pts", k, 2, prefix=f"k{k}c", distance=sq4))
        parts.append(sql_assign(f"k{k}", "pts", f"k{k}c2", "label", sq4))
        tables.append(f"SELECT {k}::INTEGER AS k, {score.format(f'k{k}')} AS score")
    return f"WITH {', '.join(parts)}, scores AS ({' UNION ALL '.join(tables)})"


_SWEEP = _sql_sweep("(SELECT avg(sqrt(d)) FROM {})")


def sweep(spark, sf_dir, score=kmeans.mean_distance):
    df = stored_lines(spark, sf_dir)
    return kmeans.sweep(df, _KS, lambda rows, k: kmeans.lloyd(rows, kmeans.first_rows(rows, k, ["id"]), 2), score)


@query("k18_sweep_over_k", f"{_SWEEP} SELECT k, {r('score')} AS score FROM scores")
def sweep_over_k(spark, sf_dir):
    return round_columns(sweep(spark, sf_dir).scores, ["score"])


@query(
    "k18_entropy_sweep",
    _sql_sweep("(" + _ENTROPY.format("{}", "label") + ")") + f" SELECT k, {r('score')} AS score FROM scores",
)
def entropy_sweep(spark, sf_dir):
    return round_columns(sweep(spark, sf_dir, kmeans.mean_entropy).scores, ["score"])


@query("k19_best_k", f"{_SWEEP} SELECT k, {r('score')} AS score FROM scores ORDER BY scores.score, k LIMIT 1")
def best_k(spark, sf_dir):
    return round_columns(kmeans.best_k(sweep(spark, sf_dir).scores), ["score"])


@query("k20_random_sample")
def random_sample(spark, sf_dir):
    """5 % of the assignments as lines of text."""
    df = stored_lines(spark, sf_dir)
    sample = kmeans.random_sample(line_centers(df).assign(df))
    return sample.select(F.concat_ws(",", F.col("cluster").cast("string"), F.col("features").cast("array<string>")).alias("line"))


@query("k21_one_in_twenty", "SELECT event_id, event_type, value FROM events WHERE event_id % 20 = 0")
def one_in_twenty(spark, sf_dir):
    return split_by_modulus(table(spark, sf_dir, "events"), "event_id", 20, 0).select("event_id", "event_type", "value")


@query("k21_hash_sample")
def hash_sample(spark, sf_dir):
    return kmeans.hash_sample(table(spark, sf_dir, "events"), ["event_id"]).select("event_id", "event_type", "value")
