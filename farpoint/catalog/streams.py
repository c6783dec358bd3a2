"""Streaming k-means on the events, replayed in three slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import query, r, rounded, sql_assign, sql_outcome, sql_seeds, table
from farpoint.operators import kmeans
from farpoint.operators.kmeans import Centers
from farpoint.session import scratch_path
from farpoint.sources.records import read_lines, write_delimited
from farpoint.streaming import online_kmeans as online

_K, _SLICES, _CUT = 4, 3, 1500.0
_NUDGE, _HALF_LIFE = 0.05, 5000
_ONCE = {"availableNow": True}

_POINTS = """pts AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS label,
  [value, user_id::DOUBLE] AS x FROM events)"""


def _distance(a, b):
    return f"({a}[1] - {b}[1]) * ({a}[1] - {b}[1]) + ({a}[2] - {b}[2]) * ({a}[2] - {b}[2])"


def _sql_split(name, folded):
    """The lightest centre, where it dies, next to the heaviest."""
    moved = ", ".join(f"b[{i}] + sign * {_NUDGE} * greatest(abs(b[{i}]), 1)" for i in (1, 2))
    return f"""{name} AS MATERIALIZED (SELECT cluster, CASE WHEN sign = 0 THEN x ELSE [{moved}] END AS x,
      CASE WHEN sign = 0 THEN w ELSE (top + low) / 2 END AS w FROM (
        SELECT u.*, s.*, CASE WHEN NOT low < 1e-8 * top THEN 0 WHEN cluster = heavy THEN 1 WHEN cluster = light THEN -1 ELSE 0 END AS sign
        FROM {folded} u CROSS JOIN (SELECT max(w) AS top, min(w) AS low, arg_max(cluster, w) AS heavy, arg_min(cluster, w) AS light,
          arg_max(x, w) AS b FROM {folded}) s))"""


def _sql_fold(start="x", decay="1.0", split=False):
    parts = [_POINTS, sql_seeds("seeds", "pts", _K), f"v0 AS (SELECT cluster, {start} AS x, 0.0::DOUBLE AS w FROM seeds)"]
    for i in range(_SLICES):
        parts.append(f"s{i} AS (SELECT id, x FROM pts WHERE id % {_SLICES} = {i})")
        parts.append(sql_assign(f"a{i}", f"s{i}", f"v{i}", distance=_distance))
        parts.append(f"o{i} AS (SELECT cluster, x, w * {decay.format(rows=f'(SELECT count(*) FROM s{i})')} AS w FROM v{i})")
        name = f"u{i + 1}" if split else f"v{i + 1}"
        parts.append(
            f"""{name} AS MATERIALIZED (SELECT v.cluster, CASE WHEN m.n IS NULL THEN v.x ELSE
              [(v.x[1] * w + m.s1) / (w + m.n), (v.x[2] * w + m.s2) / (w + m.n)] END AS x, w + coalesce(m.n, 0) AS w
              FROM o{i} v LEFT JOIN (SELECT cluster, count(*) AS n, sum(x[1]) AS s1, sum(x[2]) AS s2 FROM a{i} GROUP BY cluster) m
              ON m.cluster = v.cluster)"""
        )
        if split:
            parts.append(_sql_split(f"v{i + 1}", name))
    return "WITH " + ",\n".join(parts)


_FOLD = _sql_fold()


def points(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)
    return events.select(F.col("event_id").alias("id"), label.alias("label"), F.array("value", F.col("user_id").cast("double")).alias("features"))


def trained(spark, sf_dir, far=False, **options):
    """Each slice arrives as new files; every run of the stream takes it as one batch."""
    root = scratch_path(spark, "stream")
    df = points(spark, sf_dir)
    state = online.State(spark, f"{root}/state")
    centers = kmeans.first_rows(df, _K, ["id"])
    if far:
        centers[-1] = 1e9
    state.start(centers)
    for i in range(_SLICES):
        write_delimited(df.filter(F.col("id") % _SLICES == i).select("features"), f"{root}/training/slice{i}")
        stream = online.training_stream(spark, f"{root}/training/*", 2)
        online.train_on(stream, state, f"{root}/train-checkpoint", trigger=_ONCE, **options).awaitTermination()
    return root, state


def testing(spark, sf_dir, root):
    path = f"{root}/testing"
    write_delimited(points(spark, sf_dir).select("label", "features"), path)
    return online.testing_stream(spark, path, 2)


@query("s1_directory_stream")
def directory_stream(spark, sf_dir):
    """Rows per micro-batch when a directory of text files is read a few files at a time."""
    root = scratch_path(spark, "stream")
    write_delimited(points(spark, sf_dir).select("features").repartition(4), f"{root}/training")
    state = online.State(spark, f"{root}/state")
    state.start_random(_K, 2)
    stream = online.training_stream(spark, f"{root}/training", 2, maxFilesPerTrigger="1")
    online.train_on(stream, state, f"{root}/checkpoint", trigger=_ONCE).awaitTermination()
    return state.history().groupBy("version").agg(F.sum("weight").alias("rows"))


@query("s2_label_first_rows", f"WITH {_POINTS} SELECT label::DOUBLE AS label, x[1] AS value, x[2] AS user FROM pts")
def label_first_rows(spark, sf_dir):
    root = scratch_path(spark, "labelled")
    write_delimited(points(spark, sf_dir).select("label", "features"), root)
    label, features = online.label_first(F.col("fields"))
    df = read_lines(spark, root).select(F.split("value", ",").alias("fields"))
    df = df.select(label.alias("label"), features.alias("features"))
    return df.select("label", F.col("features")[0].alias("value"), F.col("features")[1].alias("user"))


def _history(df):
    return df.select(
        "version",
        "cluster",
        rounded(F.col("center")[0]).alias("x1"),
        rounded(F.col("center")[1]).alias("x2"),
        "weight",
    )


def _sql_version(i):
    return f"SELECT {i}::INTEGER AS version, cluster::INTEGER AS cluster, {r('x[1]')} AS x1, {r('x[2]')} AS x2, w::DOUBLE AS weight FROM v{i}"


@query("s3_streaming_kmeans", f"{_FOLD} {_sql_version(_SLICES)}")
def streaming_kmeans(spark, sf_dir):
    _, state = trained(spark, sf_dir)
    return _history(state.history().filter(F.col("version") == state.latest_version()))


@query("s4_center_history", f"{_FOLD} {' UNION ALL '.join(_sql_version(i) for i in range(_SLICES + 1))}")
def center_history(spark, sf_dir):
    _, state = trained(spark, sf_dir)
    return _history(state.history())


_ALL_VERSIONS = " UNION ALL ".join(_sql_version(i) for i in range(_SLICES + 1))


@query("s3_dying_center_split", f"{_sql_fold(f'CASE WHEN cluster = {_K - 1} THEN [1e9, 1e9] ELSE x END', split=True)} {_ALL_VERSIONS}")
def dying_center_split(spark, sf_dir):
    """All versions of a stream that starts with a centre far from every row, which the first batch moves."""
    return _history(trained(spark, sf_dir, far=True, nudge=_NUDGE)[1].history())


_SQL_WEIGHT = "SELECT {i}::INTEGER AS version, cluster::INTEGER AS cluster, {x1} AS x1, {x2} AS x2, {w} AS weight FROM v{i}"


@query(
    "s3_half_life_in_points",
    f"{_sql_fold(decay=f'pow(0.5, {{rows}} / {_HALF_LIFE}.0)')} "
    + " UNION ALL ".join(_SQL_WEIGHT.format(i=i, x1=r("x[1]"), x2=r("x[2]"), w=r("w")) for i in range(_SLICES + 1)),
)
def half_life_in_points(spark, sf_dir):
    """All versions when a row counts half after the next 5000."""
    _, state = trained(spark, sf_dir, decay=online.half_life(_HALF_LIFE), unit="points")
    return _history(state.history()).withColumn("weight", rounded("weight"))


_DUMP = 1000


@query(
    "s4_dumps_by_count",
    f"""{_FOLD}, seen AS (SELECT version, (SELECT count(*) FROM pts WHERE id % {_SLICES} < version) AS n
      FROM range({_SLICES + 1}) t(version)),
    due AS (SELECT a.version, a.n FROM seen a JOIN seen b ON a.version = b.version + 1 WHERE a.n // {_DUMP} > b.n // {_DUMP})
    SELECT h.*, due.n AS seen FROM ({_ALL_VERSIONS}) h JOIN due USING (version)""",
)
def dumps_by_count(spark, sf_dir):
    """The centres at each batch in which the rows seen passed another thousand."""
    df = trained(spark, sf_dir)[1].dumps(_DUMP)
    return df.select("version", "cluster", rounded(F.col("center")[0]).alias("x1"), rounded(F.col("center")[1]).alias("x2"), "weight", "seen")


_JUDGED = f"""{_FOLD}, {sql_assign("f", "pts", f"v{_SLICES}", "label", _distance)},
judged AS (SELECT *, CASE WHEN d < {_CUT} THEN 'normal' ELSE 'attack' END AS judged,
  {sql_outcome("label = 0", f"d < {_CUT}", "attack")} AS outcome FROM f)"""


def scored(spark, sf_dir):
    root, state = trained(spark, sf_dir)
    stream = testing(spark, sf_dir, root)
    online.score_on(
        stream, state, f"{root}/score-checkpoint", f"{root}/results", f"{root}/feedback", _CUT, trigger=_ONCE
    ).awaitTermination()
    return root, spark.read.parquet(f"{root}/results/b*")


@query(
    "s5_streamed_judgements",
    f"{_JUDGED} SELECT x[1] AS value, x[2] AS user, cluster::INTEGER AS cluster, {r('d')} AS d, judged FROM judged",
)
def streamed_judgements(spark, sf_dir):
    _, df = scored(spark, sf_dir)
    f = F.col("features")
    return df.select(f[0].alias("value"), f[1].alias("user"), "cluster", rounded("sq_distance").alias("d"), "judged")


@query("s6_feedback_rows", f"{_JUDGED} SELECT x[1] AS value, x[2] AS user FROM judged WHERE judged = 'normal'")
def feedback_rows(spark, sf_dir):
    """Rows judged normal, as the training stream would read them."""
    root, _ = scored(spark, sf_dir)
    parts = F.split("value", ",")
    df = read_lines(spark, f"{root}/feedback/*")
    return df.select(parts[0].cast("double").alias("value"), parts[1].cast("double").alias("user"))


@query("s7_streamed_outcomes", f"{_JUDGED} SELECT outcome, count(*) AS n FROM judged GROUP BY outcome")
def streamed_outcomes(spark, sf_dir):
    _, df = scored(spark, sf_dir)
    return df.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "s7_running_outcome_counts",
    f"""WITH {_POINTS}, {sql_seeds("seeds", "pts", _K)}, {sql_assign("f", "pts", "seeds", "label", _distance)},
    judged AS (SELECT {sql_outcome("label = 0", f"d < {_CUT}", "attack")} AS outcome FROM f)
    SELECT outcome, count(*) AS n FROM judged GROUP BY outcome""",
)
def running_outcome_counts(spark, sf_dir):
    """Counts kept up to date by the stream itself, for fixed centres."""
    root = scratch_path(spark, "stream")
    centers = Centers(kmeans.first_rows(points(spark, sf_dir), _K, ["id"]))
    name = f"outcomes_{root[-12:]}"
    stream = testing(spark, sf_dir, root)
    online.outcome_counts_on(stream, centers, name, f"{root}/checkpoint", _CUT).awaitTermination()
    return spark.table(name)


_DAYS, _ARRIVALS = 10, 3
_ARRIVED = f"""rows AS (SELECT event_id AS id, ts, time_bucket(INTERVAL 1 HOUR, ts) AS hour,
  least({_ARRIVALS - 1}, (extract(day FROM ts)::INT - 1) // {_DAYS}) + (event_id % 50 = 0)::INT AS arrival FROM events),
marks AS (SELECT a.arrival, max(b.ts) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT arrival FROM rows) a
  LEFT JOIN rows b ON b.arrival < a.arrival GROUP BY a.arrival),
counted AS (SELECT id, hour FROM rows JOIN marks USING (arrival) WHERE mark IS NULL OR hour + INTERVAL 1 HOUR > mark)"""


@query(
    "s7_outcomes_by_event_time",
    f"""WITH {_POINTS}, {sql_seeds("seeds", "pts", _K)}, {sql_assign("f", "pts", "seeds", "label", _distance)}, {_ARRIVED},
    judged AS (SELECT id, {sql_outcome("label = 0", f"d < {_CUT}", "attack")} AS outcome FROM f)
    SELECT strftime(hour, '%Y-%m-%d %H:%M') AS hour, outcome, count(*) AS n FROM judged JOIN counted USING (id) GROUP BY hour, outcome""",
)
def outcomes_by_event_time(spark, sf_dir):
    """Hourly outcomes of events that arrive in three parts and, one in fifty, a part late: such a row
    counts if its hour ends within two days of the latest event before."""
    root = scratch_path(spark, "stream")
    centers = Centers(kmeans.first_rows(points(spark, sf_dir), _K, ["id"]))
    when = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"))
    df = points(spark, sf_dir).join(when, "id")
    part = F.least(F.lit(_ARRIVALS - 1), F.floor((F.dayofmonth("time") - 1) / _DAYS)) + F.when(F.col("id") % 50 == 0, 1).otherwise(0)
    df = df.withColumn("arrival", part.cast("int"))
    for i in range(_ARRIVALS + 1):
        df.filter(F.col("arrival") == i).drop("arrival", "id").write.parquet(f"{root}/arrivals/part{i}")
        stream = spark.readStream.schema("label double, features array<double>, time timestamp").parquet(f"{root}/arrivals/*")
        online.windowed_outcomes_on(
            stream, centers, f"{root}/checkpoint", f"{root}/counts", "1 hour", "2 days", threshold=_CUT, trigger=_ONCE
        ).awaitTermination()
    counts = online.windowed_outcomes(spark, f"{root}/counts")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "outcome", "n")
