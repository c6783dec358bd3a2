"""Sparse one-hot rows against the dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.operators import encode, sparse
from farpoint.session import materialize

ROWS = [(1, 0.5, "tcp", "b", 3.0), (2, -1.0, " udp", "a", 0.0), (3, 2.0, "tcp", "c", 1.5), (4, 0.0, "icmp", "a", 2.0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, n1 double, k1 string, k2 string, n2 double")


def _sparse(df, **options):
    known = materialize(encode.dictionary(df, ["k1", "k2"]), "dictionary")
    return sparse.encode_sparse(df, ["n1", "n2"], known, **options)


def test_rows_distances_and_products_equal_the_dense_ones(frame):
    dense = encode.encode(frame, ["n1", "n2"], encode.fit_one_hot(frame, ["k1", "k2"]))
    want = np.array([r.features for r in dense.orderBy("id").collect()])
    rows = _sparse(frame)
    assert rows.columns == [*frame.columns, "features"]
    got = np.array([sparse.to_dense(r.features) for r in rows.orderBy("id").collect()])
    np.testing.assert_array_equal(got, want)
    centers = np.concatenate([want[:2], np.random.default_rng(1).normal(size=(2, want.shape[1])), 0 * want[:1]])
    gaps = ((want[:, None] - centers[None]) ** 2).sum(axis=2)
    for size in (0, 1 << 20):  # joined by position, and along with the tasks
        out = sparse.center_distances(rows, centers, model_bytes=size).orderBy("id").collect()
        np.testing.assert_allclose([r.dists for r in out], gaps, atol=1e-12)
        out = sparse.products(rows, centers, "p", model_bytes=size).orderBy("id").collect()
        np.testing.assert_allclose([r.p for r in out], want @ centers.T, atol=1e-12)
        out = sparse.assign(rows, centers[:2], model_bytes=size).orderBy("id").collect()
        assert [r.cluster for r in out] == gaps[:, :2].argmin(axis=1).tolist()
    out = sparse.center_distances(rows, [r.features for r in rows.orderBy("id").limit(2).collect()]).orderBy("id").collect()
    np.testing.assert_allclose([r.dists for r in out], gaps[:, :2], atol=1e-12)
    a, b = rows.select("id", F.col("features").alias("a")), rows.select(F.col("id").alias("o"), F.col("features").alias("b"))
    for r in a.crossJoin(b).select("id", "o", sparse.squared(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == pytest.approx(((want[r.id - 1] - want[r.o - 1]) ** 2).sum())


def test_unseen_values(frame):
    known = materialize(encode.dictionary(frame.filter("k1 <> 'icmp'"), ["k1", "k2"]), "dictionary")
    kept = sparse.encode_sparse(frame, ["n1", "n2"], known, unseen="keep").orderBy("id").collect()
    assert [len(r.features.indices) for r in kept] == [4, 4, 4, 3]
    assert sparse.encode_sparse(frame, ["n1", "n2"], known, unseen="skip").count() == 3
    with pytest.raises(Exception, match="not in dictionary: icmp"):
        sparse.encode_sparse(frame, ["n1", "n2"], known).collect()
    with pytest.raises(ValueError):
        sparse.encode_sparse(frame, ["n1"], known, unseen="guess")


def test_a_dictionary_of_a_hundred_thousand_values(spark, monkeypatch):
    monkeypatch.setattr(sparse, "_DICTIONARY_BYTES", 1000)  # joined by a shuffle
    df = spark.range(100_000).select("id", F.lit(1.0).alias("n1"), F.format_string("v%06d", "id").alias("k1"))
    known = materialize(encode.dictionary(df, ["k1"]), "dictionary")
    rows = sparse.encode_sparse(df, ["n1"], known)
    assert rows.filter((F.col("features.size") != 100_001) | (F.col("features.indices")[1] != F.col("id") + 1)).count() == 0
    centers = np.zeros((2, 100_001))
    centers[0, 8] = centers[1, 0] = 1.0
    near = sparse.assign(rows, centers).filter("cluster = 0").collect()
    assert [(r.id, r.sq_distance) for r in near] == [(7, 1.0)]  # as far from either, so the lower one
