"""Dictionaries, one-hot rows, statistics, scaling and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from farpoint.catalog.base import (
    NUMBERS,
    SQL_EMBEDDINGS,
    SQL_ID,
    SQL_LINES,
    embeddings,
    lines,
    query,
    r,
    round_columns,
    rounded,
    table,
)
from farpoint.operators import encode, pca, scale, sparse
from farpoint.session import materialize
from farpoint.sources import records

_TEXT = ("l_returnflag", "l_linestatus")


@query(
    "c1_dictionary",
    """SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY value) - 1)::INTEGER AS idx FROM (
      SELECT 'p_brand' AS feature, p_brand AS value FROM part
      UNION SELECT 'p_type', p_type FROM part)""",
)
def dictionary(spark, sf_dir):
    return encode.dictionary(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query(
    "c2_one_hot",
    f"""SELECT {SQL_ID} AS id, l_quantity AS x0,
      {", ".join(f"CASE WHEN l_returnflag = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x{i}" for i, v in enumerate("ANR", 1))},
      {", ".join(f"CASE WHEN l_linestatus = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x{i}" for i, v in enumerate("FO", 4))},
      l_extendedprice AS x6, l_discount AS x7, l_tax AS x8 FROM lineitem""",
)
def one_hot(spark, sf_dir):
    df = lines(spark, sf_dir)
    encoded = encode.encode(df, NUMBERS, encode.fit_one_hot(df, _TEXT))
    return encoded.select("id", *[F.col("features")[i].alias(f"x{i}") for i in range(9)])


_WIDE = ("l_partkey", "l_suppkey", "l_linestatus")


def sparse_lines(spark, sf_dir):
    """Order lines with a one-hot position for every part and supplier; the numbers are whole hundredths."""
    df = lines(spark, sf_dir).select("id", "l_quantity", (F.col("l_discount") * 100).alias("discount"), *[F.col(c).cast("string") for c in _WIDE])
    known = materialize(encode.dictionary(df, _WIDE), "dictionary")
    return sparse.encode_sparse(df, ["l_quantity", "discount"], known)


_SPARSE_CTE = f"""{", ".join(
    f"d_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM lineitem))" for c in _WIDE)},
    sparse AS MATERIALIZED (SELECT {SQL_ID} AS id, l_quantity AS q, l_discount * 100 AS d, l_partkey AS p, l_suppkey AS s, l_linestatus AS l,
      1 + t.i AS i1, 1 + (SELECT count(*) FROM d_l_linestatus) + p.i AS i2,
      1 + (SELECT count(*) FROM d_l_linestatus) + (SELECT count(*) FROM d_l_partkey) + s.i AS i3,
      1 + (SELECT count(*) FROM d_l_linestatus) + (SELECT count(*) FROM d_l_partkey) + (SELECT count(*) FROM d_l_suppkey) AS i4
      FROM lineitem JOIN d_l_partkey p ON p.v = l_partkey::VARCHAR JOIN d_l_suppkey s ON s.v = l_suppkey::VARCHAR
        JOIN d_l_linestatus t ON t.v = l_linestatus)"""


@query(
    "c2_sparse_one_hot",
    f"""WITH {_SPARSE_CTE} SELECT id, (i4 + 1)::INTEGER AS size, concat_ws(',', 0, i1, i2, i3, i4) AS indices, q AS x0, {r("d")} AS x4
    FROM sparse""",
)
def sparse_one_hot(spark, sf_dir):
    """One position for every part and supplier, in rows of five entries."""
    f = F.col("features")
    return sparse_lines(spark, sf_dir).select(
        "id",
        f["size"].alias("size"),
        F.concat_ws(",", f["indices"].cast("array<string>")).alias("indices"),
        f["values"][0].alias("x0"),
        rounded(f["values"][4]).alias("x4"),
    )


@query(
    "k5_sparse_assign",
    f"""WITH {_SPARSE_CTE}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, * FROM (SELECT * FROM sparse ORDER BY id LIMIT 4)),
    gaps AS (SELECT x.id, cluster, round((x.q - c.q) ** 2 + (x.d - c.d) ** 2 + 2 * ((x.p <> c.p)::INT + (x.s <> c.s)::INT + (x.l <> c.l)::INT), 6) AS g
      FROM sparse x CROSS JOIN c)
    SELECT id, arg_min(cluster, g * 10 + cluster)::INTEGER AS cluster, min(g) + 0.0 AS d FROM gaps GROUP BY id""",
)
def sparse_assign(spark, sf_dir):
    """The nearest of four order lines, by sparse rows; a mismatch of parts, suppliers or states weighs 2."""
    df = materialize(sparse_lines(spark, sf_dir), "sparse")
    centers = [row.features for row in df.orderBy("id").limit(4).collect()]
    found = sparse.center_distances(df, centers)
    near = F.transform("dists", lambda d: F.round(d, 6))
    least = F.array_min(near)
    return found.select("id", (F.array_position(near, least) - 1).cast("int").alias("cluster"), least.alias("d"))


@query(
    "c3_unseen_category",
    """SELECT event_type, event_type <> 'error' AS known, count(*) AS n FROM events GROUP BY 1""",
)
def unseen_category(spark, sf_dir):
    """A value outside the dictionary gives an all-zero block when unseen ones are kept."""
    events = table(spark, sf_dir, "events")
    model = encode.fit_one_hot(events.filter(F.col("event_type") != "error"), ["event_type"])
    encoded = encode.encode(events, ["value"], model, unseen="keep")
    block = F.slice("features", 2, model.width())
    known = F.aggregate(block, F.lit(0.0), lambda acc, v: acc + v) == 1.0
    return encoded.select("event_type", known.alias("known")).groupBy("event_type", "known").agg(F.count("*").alias("n"))


_STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS n, {r(f"sum({c})", 2)} AS total,
    {r(f"sum({c} * {c}) / count({c})", 3)} AS mean_sq, {r(f"avg({c})")} AS mean, {r(f"stddev_pop({c})")} AS sd FROM lineitem"""
    for c in NUMBERS
)


@query("c4_column_stats", _STATS)
def column_stats(spark, sf_dir):
    stats = scale.column_stats(table(spark, sf_dir, "lineitem"), NUMBERS)
    return stats.select(
        "feature",
        "n",
        rounded("total", 2).alias("total"),
        rounded(F.col("total_sq") / F.col("n"), 3).alias("mean_sq"),
        rounded("mean").alias("mean"),
        rounded("sd").alias("sd"),
    )


def _z(columns, deviation="stddev_pop", guard=""):
    parts = []
    for c in columns:
        only_centre = f"s_{c} <= 0{guard.format(c=c)}"
        parts.append(f"{r(f'CASE WHEN {only_centre} THEN {c} - m_{c} ELSE ({c} - m_{c}) / s_{c} END')} AS {c}")
    stats = ", ".join(f"avg({c}) AS m_{c}, {deviation}({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in columns)
    return ", ".join(parts), stats


_ZP, _ZS = _z((*NUMBERS, "constant"))


@query(
    "c5_zscore",
    f"""WITH l AS (SELECT *, 3.0::DOUBLE AS constant FROM lineitem), s AS (SELECT {_ZS} FROM l)
    SELECT {SQL_ID} AS id, {_ZP} FROM l, s""",
)
def zscore(spark, sf_dir):
    """A column without spread is only centred."""
    df = lines(spark, sf_dir).withColumn("constant", F.lit(3.0))
    columns = (*NUMBERS, "constant")
    scaled = scale.fit_columns(df, columns).transform(df)
    return round_columns(scaled.select("id", *columns), columns)


_CP, _CS = _z(NUMBERS, guard=" OR q_{c} >= 2e8")


@query("c6_zscore_capped", f"WITH s AS (SELECT {_CS} FROM lineitem) SELECT {SQL_ID} AS id, {_CP} FROM lineitem, s")
def zscore_capped(spark, sf_dir):
    """Columns whose sum of squares reaches the cap are only centred."""
    df = lines(spark, sf_dir)
    scaled = scale.fit_columns(df, NUMBERS, sumsq_cap=2e8).transform(df)
    return round_columns(scaled.select("id", *NUMBERS), NUMBERS)


_PP, _PS = _z(NUMBERS)


@query(
    "c7_train_statistics_on_test",
    f"""WITH s AS (SELECT {_PS} FROM lineitem WHERE l_orderkey % 5 <> 0)
    SELECT {SQL_ID} AS id, {_PP} FROM lineitem, s WHERE l_orderkey % 5 = 0""",
)
def train_statistics_on_test(spark, sf_dir):
    df = lines(spark, sf_dir)
    train, test = df.filter("l_orderkey % 5 <> 0"), records.split_by_modulus(df, "l_orderkey", 5, 0)
    scaled = scale.fit_columns(train, NUMBERS).transform(test)
    return round_columns(scaled.select("id", *NUMBERS), NUMBERS)


@query(
    "c8_own_statistics_on_test",
    f"""WITH t AS (SELECT * FROM lineitem WHERE l_orderkey % 5 = 0), s AS (SELECT {_PS} FROM t)
    SELECT {SQL_ID} AS id, {_PP} FROM t, s""",
)
def own_statistics_on_test(spark, sf_dir):
    test = records.split_by_modulus(lines(spark, sf_dir), "l_orderkey", 5, 0)
    scaled = scale.fit_columns(test, NUMBERS).transform(test)
    return round_columns(scaled.select("id", *NUMBERS), NUMBERS)


_SP, _SS = _z(NUMBERS, "stddev_samp")


@query("c9_sample_standardizer", f"WITH s AS (SELECT {_SS} FROM lineitem) SELECT {SQL_ID} AS id, {_SP} FROM lineitem, s")
def sample_standardizer(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("features", F.array(*NUMBERS))
    scaled = scale.fit_vectors(df, sample=True).transform(df)
    return scaled.select("id", *[rounded(F.col("features")[i]).alias(c) for i, c in enumerate(NUMBERS)])


@query("c10_log1p", f"SELECT {SQL_ID} AS id, {', '.join(r(f'ln(1 + {c})') + f' AS {c}' for c in NUMBERS)} FROM lineitem")
def log1p(spark, sf_dir):
    logged = scale.log1p_columns(lines(spark, sf_dir), NUMBERS)
    return round_columns(logged.select("id", *NUMBERS), NUMBERS)


# --- principal components ----------------------------------------------------


@query(
    "p1_covariance",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r(f'covar_samp({a}, {b})', 4)} AS covariance FROM lineitem"
        for a in NUMBERS
        for b in NUMBERS
    ),
)
def covariance(spark, sf_dir):
    """The matrix whose eigenvectors the components are."""
    pairs = [(a, b) for a in NUMBERS for b in NUMBERS]
    wide = table(spark, sf_dir, "lineitem").agg(*[F.covar_samp(a, b).alias(f"{a}:{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.col(f"`{a}:{b}`"), 4).alias("covariance")) for a, b in pairs])
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def _sql_components(source: str, suffix: str = "") -> str:
    """Closed form for two features: unit eigenvectors, largest entry positive."""
    return f"""cov{suffix} AS (SELECT covar_samp(u, u) AS a, covar_samp(u, v) AS b, covar_samp(v, v) AS c,
        avg(u) AS mu, avg(v) AS mv FROM {source}),
    eig{suffix} AS (SELECT *, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS l1,
                   (a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b) AS l2 FROM cov{suffix}),
    raw{suffix} AS (SELECT *, b / sqrt(b * b + power(l1 - a, 2)) AS u1, (l1 - a) / sqrt(b * b + power(l1 - a, 2)) AS v1,
                   b / sqrt(b * b + power(l2 - a, 2)) AS u2, (l2 - a) / sqrt(b * b + power(l2 - a, 2)) AS v2 FROM eig{suffix}),
    pc{suffix} AS (SELECT l1, l2, mu, mv,
        u1 * CASE WHEN abs(u1) >= abs(v1) THEN sign(u1) ELSE sign(v1) END AS u1,
        v1 * CASE WHEN abs(u1) >= abs(v1) THEN sign(u1) ELSE sign(v1) END AS v1,
        u2 * CASE WHEN abs(u2) >= abs(v2) THEN sign(u2) ELSE sign(v2) END AS u2,
        v2 * CASE WHEN abs(u2) >= abs(v2) THEN sign(u2) ELSE sign(v2) END AS v2 FROM raw{suffix})"""


_TWO = f"{SQL_LINES}, two AS (SELECT id, l_orderkey, label, ln(1 + l_quantity) AS u, ln(1 + l_discount) * 30 AS v FROM lines)"


def two_features(spark, sf_dir):
    df = lines(spark, sf_dir)
    pair = F.array(F.log1p("l_quantity"), F.log1p("l_discount") * 30)
    return df.select("id", "l_orderkey", "label", pair.alias("features"))


def _projected(df):
    return df.select("id", rounded(F.col("features")[0], 5).alias("s1"), rounded(F.col("features")[1], 5).alias("s2"))


@query(
    "p1_components",
    f"""WITH {_TWO}, {_sql_components("two")}
    SELECT 0::INTEGER AS feature, 0::INTEGER AS component, {r("u1", 5)} AS weight FROM pc
    UNION ALL SELECT 1, 0, {r("v1", 5)} FROM pc UNION ALL SELECT 0, 1, {r("u2", 5)} FROM pc
    UNION ALL SELECT 1, 1, {r("v2", 5)} FROM pc""",
)
def components(spark, sf_dir):
    model = pca.fit_components(two_features(spark, sf_dir), 2)
    return round_columns(model.table(spark), ["weight"], 5)


@query(
    "p1_wide_components",
    f"""WITH {_TWO}, {_sql_components("two")}
    SELECT 0::INTEGER AS feature, 0::INTEGER AS component, {r("u1", 5)} AS weight FROM pc
    UNION ALL SELECT 1, 0, {r("v1", 5)} FROM pc""",
)
def wide_components(spark, sf_dir):
    """The first component by subspace iteration, which never holds the covariance."""
    model = pca.fit_wide_components(two_features(spark, sf_dir), 1)
    return round_columns(model.table(spark), ["weight"], 5)


@query("p1_wide_components_angles")
def wide_components_angles(spark, sf_dir):
    """Cosines between the first five components of the embeddings and those of the whole covariance."""
    df = embeddings(spark, sf_dir)
    wide, whole = pca.fit_wide_components(df, 5, passes=100), pca.fit_components(df, 5)
    cosines = (wide.matrix * whole.matrix).sum(axis=0)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(cosines)], "component int, cosine double")


@query("p2_all_components")
def all_components(spark, sf_dir):
    """Every component of the embeddings with its share of the variance."""
    model = pca.fit_components(embeddings(spark, sf_dir))
    rows = [(i, float(v)) for i, v in enumerate(model.variance_share)]
    return spark.createDataFrame(rows, "component int, variance_share double")


@query(
    "p2_all_components_keep_lengths",
    f"""WITH {SQL_EMBEDDINGS}, spread AS (SELECT sum(v) AS total FROM (SELECT var_samp(v) AS v FROM (
      SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM pts) GROUP BY pos))
    SELECT id, len(x)::INTEGER AS components, {r("list_sum(list_transform(x, lambda v: v * v))", 5)} AS sq_length,
      {r("total", 5)} AS variance FROM pts, spread""",
)
def all_components_keep_lengths(spark, sf_dir):
    """On all components, which are orthonormal, rows keep their lengths and the columns their total variance."""
    df = embeddings(spark, sf_dir)
    model = pca.fit_components(df)
    scores = materialize(model.project(df, output="scores").select("id", "scores"), "scores")
    total = scores.agg(*[F.var_samp(F.col("scores")[i]) for i in range(model.matrix.shape[1])]).first()
    squares = F.aggregate("scores", F.lit(0.0), lambda acc, v: acc + v * v)
    return scores.select(
        "id",
        F.size("scores").alias("components"),
        rounded(squares, 5).alias("sq_length"),
        rounded(F.lit(float(sum(total))), 5).alias("variance"),
    )


@query(
    "p3_projection",
    f"WITH {_TWO}, {_sql_components('two')} SELECT id, {r('u * u1 + v * v1', 5)} AS s1, {r('u * u2 + v * v2', 5)} AS s2 FROM two, pc",
)
def projection(spark, sf_dir):
    df = two_features(spark, sf_dir)
    return _projected(pca.fit_components(df, 2).project(df))


@query(
    "p4_centered_projection",
    f"""WITH {_TWO}, {_sql_components('two')} SELECT id, {r('(u - mu) * u1 + (v - mv) * v1', 5)} AS s1,
    {r('(u - mu) * u2 + (v - mv) * v2', 5)} AS s2 FROM two, pc""",
)
def centered_projection(spark, sf_dir):
    df = two_features(spark, sf_dir)
    return _projected(pca.fit_components(df, 2, centered=True).project(df))


@query(
    "p5_train_components_on_test",
    f"""WITH {_TWO}, train AS (SELECT * FROM two WHERE l_orderkey % 5 <> 0), {_sql_components('train')}
    SELECT id, {r('u * u1 + v * v1', 5)} AS s1, {r('u * u2 + v * v2', 5)} AS s2 FROM two, pc WHERE l_orderkey % 5 = 0""",
)
def train_components_on_test(spark, sf_dir):
    df = two_features(spark, sf_dir)
    model = pca.fit_components(df.filter("l_orderkey % 5 <> 0"), 2)
    return _projected(model.project(records.split_by_modulus(df, "l_orderkey", 5, 0)))


@query(
    "p6_two_component_models",
    f"""WITH {_TWO}, normal AS (SELECT * FROM two WHERE label = 'normal.'), {_sql_components('two')},
    {_sql_components('normal', '_n')}
    SELECT id, {r('u * pc.u1 + v * pc.v1', 5)} AS mixed, {r('u * pc_n.u1 + v * pc_n.v1', 5)} AS normal FROM two, pc, pc_n""",
)
def two_component_models(spark, sf_dir):
    df = two_features(spark, sf_dir)
    mixed = pca.fit_components(df, 1)
    normal = pca.fit_components(df.filter(F.col("label") == "normal."), 1)
    both = normal.project(mixed.project(df, output="mixed"), output="normal")
    return both.select("id", rounded(F.col("mixed")[0], 5).alias("mixed"), rounded(F.col("normal")[0], 5).alias("normal"))
