"""Encoding, scaling, components and distances."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from farpoint.functions import vectors
from farpoint.operators import encode, pca, scale


@pytest.fixture()
def mixed(spark):
    rows = [(1.0, "tcp", "a", 5.0), (2.0, " udp", "b", 6.0), (3.0, "icmp", "a", 7.0)]
    return spark.createDataFrame(rows, "f0 double, p string, s string, f4 double")


def test_dictionary_is_sorted_and_trimmed(mixed):
    rows = encode.dictionary(mixed, ["p", "s"]).collect()
    found = {(r.feature, r.value): r.idx for r in rows}
    assert found == {("p", "icmp"): 0, ("p", "tcp"): 1, ("p", "udp"): 2, ("s", "a"): 0, ("s", "b"): 1}


def test_layout_puts_blocks_after_the_first_number(mixed):
    out = encode.encode(mixed, ["f0", "f4"], encode.fit_one_hot(mixed, ["p", "s"]))
    assert [r.features for r in out.orderBy("f0").collect()] == [
        [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 5.0],
        [2.0, 0.0, 0.0, 1.0, 0.0, 1.0, 6.0],
        [3.0, 1.0, 0.0, 0.0, 1.0, 0.0, 7.0],
    ]


def test_unseen_values(spark, mixed):
    model = encode.fit_one_hot(mixed, ["p"])
    new = spark.createDataFrame([(1.0, "gre"), (2.0, "tcp")], "f0 double, p string")
    with pytest.raises(PySparkException, match="gre"):
        encode.encode(new, ["f0"], model).collect()
    kept = encode.encode(new, ["f0"], model, unseen="keep").orderBy("f0").collect()
    assert [r.features for r in kept] == [[1.0, 0.0, 0.0, 0.0], [2.0, 0.0, 1.0, 0.0]]
    assert encode.encode(new, ["f0"], model, unseen="skip").count() == 1


def test_dictionary_width_is_checked(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError, match="distinct"):
        encode.fit_one_hot(df, ["v"], max_values=10)


@pytest.mark.parametrize("partitions", [1, 7])
def test_statistics_do_not_depend_on_partitions(spark, partitions):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double").repartition(partitions)
    row = scale.column_stats(df, ["x"]).first()
    assert (row.n, row.total, row.total_sq, row["mean"]) == (3, 6.0, 14.0, 2.0)
    assert row.sd == pytest.approx(np.sqrt(2 / 3))


def test_scaled_columns_have_mean_zero_and_unit_deviation(spark, points_df):
    rng = np.random.default_rng(1)
    matrix = np.column_stack([rng.normal(5, 3, 200), rng.uniform(size=200), np.full(200, 4.0)])
    df = points_df(matrix).repartition(5)
    scaled = scale.fit_vectors(df).transform(df)
    out = np.array([r.features for r in scaled.collect()])
    np.testing.assert_allclose(out.mean(axis=0), 0, atol=1e-12)
    np.testing.assert_allclose(out.std(axis=0), [1, 1, 0], atol=1e-12)
    wide = df.select(*[F.col("features")[i].alias(f"c{i}") for i in range(3)])
    columns = scale.fit_columns(wide, ["c0", "c1", "c2"]).transform(wide)
    np.testing.assert_allclose(np.sort(np.array(columns.collect()), axis=0), np.sort(out, axis=0), atol=1e-9)


def test_cap_turns_scaling_into_centring(points_df):
    df = points_df(np.array([[0.0, 0.0], [2e4, 1.0]]))
    out = scale.fit_vectors(df, sumsq_cap=2e8).transform(df).orderBy("id").collect()
    np.testing.assert_allclose([r.features for r in out], [[-1e4, -1.0], [1e4, 1.0]])


def test_components_are_orthonormal_and_explain_the_variance(points_df):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 7
    model = pca.fit_components(points_df(matrix))
    np.testing.assert_allclose(model.matrix.T @ model.matrix, np.eye(5), atol=1e-9)
    values = np.sort(np.linalg.eigvalsh(np.cov(matrix.T)))[::-1]
    np.testing.assert_allclose(model.variance_share, values / values.sum(), atol=1e-9)
    largest = np.abs(model.matrix).argmax(axis=0)
    assert (model.matrix[largest, range(5)] > 0).all()


def test_projection_is_raw_unless_centred(points_df):
    matrix = np.random.default_rng(3).normal(4, 1, size=(100, 3))
    df = points_df(matrix)
    raw, centred = pca.fit_components(df, 2), pca.fit_components(df, 2, centered=True)
    out = np.array([r.features for r in raw.project(df).orderBy("id").collect()])
    np.testing.assert_allclose(out, matrix @ raw.matrix)
    out = np.array([r.features for r in centred.project(df).orderBy("id").collect()])
    np.testing.assert_allclose(out, (matrix - matrix.mean(axis=0)) @ raw.matrix, atol=1e-9)


def test_nearest_breaks_ties_by_index_and_survives_large_offsets():
    rng = np.random.default_rng(4)
    centers = np.array([[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]])
    assert vectors.nearest(np.array([[0.0, 0.0], [1.0, 5.0]]), centers)[0].tolist() == [0, 0]
    rows, far = rng.normal(size=(500, 8)) + 1e7, rng.normal(size=(20, 8)) + 1e7
    exact = vectors.pairwise_squared(rows, far)
    index, distance = vectors.nearest(rows, far)
    assert (index == exact.argmin(axis=1)).all()
    np.testing.assert_allclose(distance, exact.min(axis=1))


def test_mixed_rms(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [4.0, 2.0], ["a"], ["b"])], "x array<double>, y array<double>, s array<string>, t array<string>"
    )
    d = vectors.mixed_rms(F.col("x"), F.col("y"), F.col("s"), F.col("t"))
    assert df.select(d.alias("d")).first().d == pytest.approx(np.sqrt((9 + 0 + 1) / 3))
    uneven = vectors.mixed_rms(F.col("x"), F.array(F.lit(1.0)), F.col("s"), F.col("t"))
    with pytest.raises(PySparkException, match="instances differ"):
        df.select(uneven).collect()


def test_ragged_and_missing_features_raise(spark):
    centers = np.zeros((1, 2))
    for rows in ([([1.0],)], [(None,)]):
        df = spark.createDataFrame(rows, "features array<double>")
        with pytest.raises(PySparkException):
            df.select(vectors.nearest_center(F.col("features"), centers)).collect()


def test_scaling_and_projection_in_one_step(points_df):
    matrix = np.random.default_rng(5).normal(4, 2, size=(80, 4))
    df = points_df(matrix)
    scaler = scale.fit_vectors(df)
    scaled = scaler.transform(df)
    for centered in (False, True):
        model = pca.fit_components(scaled, 2, centered=centered)
        two = [r.features for r in model.project(scaled).orderBy("id").collect()]
        one = [r.features for r in model.after(scaler.mean, scaler.divisor).project(df).orderBy("id").collect()]
        np.testing.assert_allclose(one, two, atol=1e-9)


def test_model_functions_stand_in_the_plan_once(points_df, capsys):
    df = points_df(np.random.default_rng(6).normal(size=(50, 2)))
    nearest = df.select(vectors.nearest_center(F.col("features"), np.zeros((2, 2))).alias("n")).select("n.*")
    distances = df.select(vectors.center_distances(F.col("features"), np.zeros((2, 2))).alias("d"))
    capsys.readouterr()
    nearest.filter("sq_distance > 1 and cluster = 0").explain()
    distances.select(F.explode("d")).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 2
