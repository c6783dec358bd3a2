"""Rows packed into blocks for fits of many rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.functions import vectors
from farpoint.operators import kmeans, ocsvm
from farpoint.plans import features


def test_cosines_to_double_precision():
    angles = np.random.default_rng(1).normal(scale=1000.0, size=(300, 7))
    angles[0] = [0.0, np.pi / 2, np.pi, -np.pi, 1.5 * np.pi, 2 * np.pi, -1e-9]
    found = vectors.cosines(angles / (2 * np.pi))
    assert np.abs(found - np.cos(angles)).max() < 2e-12  # the angles themselves are rounded to 4e-13
    assert np.abs(vectors.cosines(np.linspace(-1, 1, 9)) - np.cos(np.pi * np.linspace(-2, 2, 9))).max() < 3e-15


def test_packed_rows_come_back(points_df, monkeypatch):
    x = np.random.default_rng(2).normal(size=(1000, 3))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 24 * 64)
    blocks = vectors.packed(points_df(x).repartition(5), key=["id"])
    rows = blocks.collect()
    assert vectors.packed_size(blocks) == (1000, 3) and max(r.n for r in rows) <= 64
    found = np.vstack([np.frombuffer(r.x).reshape(-1, 3) for r in rows])
    np.testing.assert_array_equal(found[np.lexsort(found.T)], x[np.lexsort(x.T)])
    assert len(np.unique(np.concatenate([np.frombuffer(r.h, np.int64) for r in rows]))) == 1000


def test_uneven_and_missing_rows(spark, points_df):
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>").repartition(2)
    with pytest.raises(Exception, match="values"):
        vectors.packed_size(vectors.packed(uneven))
    with pytest.raises(ValueError, match="no rows"):
        vectors.packed_size(vectors.packed(points_df(np.zeros((1, 2))).limit(0)))


def test_a_training_step_reads_blocks_and_equals_numpy(points_df, monkeypatch):
    x = np.random.default_rng(3).normal(size=(4000, 4))
    read, step = [], ocsvm._violators

    def spied(rows, directions, phases, w, rho, *more):
        found = step(rows, directions, phases, w, rho, *more)
        z = np.sqrt(2.0 / len(phases)) * np.cos((x - x.mean(axis=0)) / x.std(axis=0, ddof=1) @ directions + phases)
        under = z @ w < rho
        assert found[0] == under.sum()
        np.testing.assert_allclose(found[1], z[under].sum(axis=0), rtol=1e-9, atol=1e-9)
        read.append(rows.count())
        return found

    monkeypatch.setattr(ocsvm, "_violators", spied)
    df = points_df(x).repartition(4)
    model = ocsvm.train(df, nu=0.1, components=32, steps=3)
    assert len(read) == 4 and max(read) <= 8  # a block or two of each task, not each row
    assert model.score(df).where("not accepted").count() == 400


def _blobs(rng, k=6, rows=400):
    return np.vstack([rng.normal(c * 10.0, 0.5, size=(rows, 3)) for c in rng.permutation(np.arange(k * 3)).reshape(k, 3)])


@pytest.mark.parametrize("init", ["k-means||", "random"])
def test_packed_training_is_lloyd_however_dealt(points_df, init):
    x = _blobs(np.random.default_rng(5))
    ks = [6, 6, 3]
    found = kmeans.train_packed(points_df(x).repartition(7), ks, ["id"], 25, init, tol=0.0)
    again = kmeans.train_packed(points_df(x[::-1], range(len(x))[::-1]).repartition(2), ks, ["id"], 25, init, tol=0.0)
    for k, model, other in zip(ks, found, again):
        d = ((x[:, None] - model.matrix[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert model.k == k and model.cost == pytest.approx(d.min(axis=1).sum())
        if init == "k-means||":  # at rest
            np.testing.assert_allclose(model.matrix, [x[near == c].mean(axis=0) for c in range(k)], atol=1e-9)
        np.testing.assert_allclose(model.matrix, other.matrix)
    if init == "k-means||":
        assert found[0].cost < 1.05 * 3 * 0.25 * len(x)  # each blob has its centre


def test_packed_training_of_copies_and_too_few(points_df):
    [model] = kmeans.train_packed(points_df(np.array([[0.0]] * 5 + [[1.0]] * 5)), [3], ["id"], 2)
    assert model.k == 3 and model.cost == 0.0
    with pytest.raises(ValueError, match="seeds wanted"):
        kmeans.train_packed(points_df(np.zeros((2, 1))), [3], ["id"])


def test_draws_are_even_and_differ():
    hashes = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 20_000)
    drawn = [kmeans._uniform(hashes, run, step) for run in (1, 2) for step in (0, 1)]
    for i, u in enumerate(drawn):
        assert abs(u.mean() - 0.5) < 0.01 and abs((u < 0.1).mean() - 0.1) < 0.01
        assert all(abs(np.corrcoef(u, v)[0, 1]) < 0.03 for v in drawn[:i])


def test_rounds_of_a_sweep_and_its_restarts_share_scans(points_df, monkeypatch):
    x = _blobs(np.random.default_rng(7), rows=50)
    scans, sums = [], kmeans.model_sums
    monkeypatch.setattr(kmeans, "model_sums", lambda rows, models: scans.append(rows.count()) or sums(rows, models))
    models = features.library(4, runs=2).sweep(points_df(x).repartition(3), [2, 4, 6])
    assert {k: m.k for k, m in models.items()} == {2: 2, 4: 4, 6: 6}
    assert 0 < len(scans) <= 3 + 4 + 1 and max(scans) <= 3  # starts, rounds, costs; a block a task
    assert features.library(4, runs=3)(points_df(x).drop("id"), 6).k == 6
    scores = {r.k: r.score for r in kmeans.mean_distances(points_df(x), list(models.values())).collect()}
    for k, m in models.items():
        assert scores[k] == pytest.approx(np.sqrt(((x[:, None] - m.matrix) ** 2).sum(axis=2).min(axis=1)).mean())


def test_entropies_of_a_sweep_from_one_scan(points_df):
    x = _blobs(np.random.default_rng(8), rows=40)
    df = points_df(x).withColumn("label", F.when(F.col("id") % 7 < 2, "a").when(F.col("id") % 7 < 3, None).otherwise("b"))
    models = kmeans.train_packed(df, [2, 5], ["id"], 3)
    found = {r.k: r.score for r in kmeans.mean_entropies(df, models).collect()}
    for m in models:
        assert found[m.k] == pytest.approx(kmeans.mean_entropy(m.assign(df)).first().score)
