"""Registry, table readers and SQL fragments shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.functions import vectors
from farpoint.operators import scale
from farpoint.operators.shape import NORMAL
from farpoint.plans.features import Layout

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where it can be said in SQL, its counterpart."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# --- Spark side --------------------------------------------------------------

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINES = Layout(NUMBERS, ("l_linestatus",))
VECTORS = Layout(tuple(f"e{i}" for i in range(64)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a string ``id`` from its key and a two-valued ``label``."""
    df = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "returned.").otherwise(NORMAL)
    return df.select(F.concat_ws("-", *KEYS).alias("id"), *KEYS, *NUMBERS, "l_returnflag", "l_linestatus", label.alias("label"))


def scaled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its four numbers z-scored into ``features``."""
    df = lines(spark, sf_dir)
    scaled = scale.fit_columns(df, NUMBERS).transform(df)
    return scaled.select("id", "label", F.array(*NUMBERS).alias("features"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, topic, label, features)``; topics 8 and 9 count as attacks."""
    df = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("label") < 8, NORMAL).otherwise(F.concat(F.lit("topic"), F.col("label").cast("string"), F.lit(".")))
    return df.select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("topic"),
        label.alias("label"),
        vectors.as_doubles(F.col("embedding")).alias("features"),
    )


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def round_columns(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


# --- SQL side ----------------------------------------------------------------


def r(expression: str, digits: int = 6) -> str:
    """Rounded, with -0.0 turned into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


SQL_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
SQL_LABEL = "CASE WHEN l_returnflag = 'R' THEN 'returned.' ELSE 'normal.' END"
SQL_LINES = f"""lines AS (
  SELECT {SQL_ID} AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, {SQL_LABEL} AS label
  FROM lineitem)"""

SQL_SCALED = f"""{SQL_LINES},
stats AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMBERS)} FROM lines),
pts AS MATERIALIZED (
  SELECT id, label, [{", ".join(f"({c} - m_{c}) / s_{c}" for c in NUMBERS)}] AS x FROM lines, stats)"""

SQL_EMBEDDINGS = """pts AS MATERIALIZED (
  SELECT vec_id AS id, label AS topic,
         CASE WHEN label < 8 THEN 'normal.' ELSE 'topic' || label || '.' END AS label,
         embedding::DOUBLE[] AS x
  FROM embeddings)"""


def sq(a: str, b: str) -> str:
    """Squared Euclidean distance of two lists."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def sq4(a: str, b: str) -> str:
    """The same written out for four elements."""
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, 5))


def sql_seeds(name: str, points: str, k: int, order: str = "id") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY {order}) - 1 AS cluster, x
  FROM (SELECT {order}, x FROM {points} ORDER BY {order} LIMIT {k}))"""


def sql_assign(name: str, points: str, centers: str, columns: str = "", distance=sq) -> str:
    """``(id, x, columns.., cluster, d)`` with the nearest centre and squared distance."""
    picked = "".join(f", any_value(p.{c.strip()}) AS {c.strip()}" for c in columns.split(",") if c.strip())
    return f"""{name} AS MATERIALIZED (
  SELECT p.id, any_value(p.x) AS x{picked}, arg_min(c.cluster, {distance("p.x", "c.x")}) AS cluster,
         min({distance("p.x", "c.x")}) AS d
  FROM {points} p CROSS JOIN {centers} c GROUP BY p.id)"""


def sql_means(name: str, assigned: str, previous: str) -> str:
    """Mean point of every cluster; an empty one keeps its centre."""
    return f"""{name} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.x, o.x) AS x
  FROM {previous} o LEFT JOIN (
    SELECT cluster, list(v ORDER BY pos) AS x
    FROM (SELECT cluster, pos, avg(v) AS v
          FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM {assigned})
          GROUP BY cluster, pos)
    GROUP BY cluster) m ON m.cluster = o.cluster)"""


def sql_lloyd(points: str, k: int, iterations: int, prefix: str = "c", order: str = "id", distance=sq) -> str:
    """Centres ``{prefix}{iterations}`` after the given number of rounds."""
    parts = [sql_seeds(f"{prefix}0", points, k, order)]
    for i in range(iterations):
        parts.append(sql_assign(f"{prefix}a{i}", points, f"{prefix}{i}", distance=distance))
        parts.append(sql_means(f"{prefix}{i + 1}", f"{prefix}a{i}", f"{prefix}{i}"))
    return ",\n".join(parts)


SQL_TOPIC_CENTERS = """centers AS MATERIALIZED (
  SELECT topic AS cluster, list(v ORDER BY pos) AS x
  FROM (SELECT topic, pos, avg(v) AS v
        FROM (SELECT topic, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM pts)
        GROUP BY topic, pos)
  GROUP BY topic)"""


def sql_outcome(normal: str, judged_normal: str, positive: str = "normal") -> str:
    truth, judged = (normal, judged_normal) if positive == "normal" else (f"NOT ({normal})", f"NOT ({judged_normal})")
    return f"""CASE WHEN ({judged}) AND ({truth}) THEN 'TP' WHEN ({judged}) AND NOT ({truth}) THEN 'FP'
       WHEN NOT ({judged}) AND NOT ({truth}) THEN 'TN' WHEN NOT ({judged}) AND ({truth}) THEN 'FN'
       ELSE 'noclass' END"""


def sql_rates(source: str, outcome: str = "outcome", by: str = "") -> str:
    """Counts and rates of an outcome column, as :func:`rates` gives them."""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}tp, fp, tn, fn, noclass,
  {r("tp::DOUBLE / nullif(tp + fp, 0)")} AS precision, {r("tp::DOUBLE / nullif(tp + fn, 0)")} AS recall,
  {r("(tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0)")} AS accuracy
FROM (SELECT {lead}count(*) FILTER ({outcome} = 'TP') AS tp, count(*) FILTER ({outcome} = 'FP') AS fp,
             count(*) FILTER ({outcome} = 'TN') AS tn, count(*) FILTER ({outcome} = 'FN') AS fn,
             count(*) FILTER ({outcome} = 'noclass') AS noclass
      FROM {source}{group})"""


def rate_columns(df: DataFrame) -> DataFrame:
    return round_columns(df, ["precision", "recall", "accuracy"])
