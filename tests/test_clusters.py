"""k-means, cluster classes, two levels, thresholds, centroid densities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.operators import centroid_lof, kmeans, labelling, threshold
from farpoint.plans.detectors import fit_two_level
from farpoint.plans.features import Layout


def blobs(seed=0, n=200):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.3, size=(n, 2)) for c in ((0, 0), (5, 5), (0, 8))])


def numpy_lloyd(x, centers, rounds):
    for _ in range(rounds):
        index = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([x[index == i].mean(axis=0) if (index == i).any() else c for i, c in enumerate(centers)])
    return centers


@pytest.mark.parametrize("partitions", [1, 7])
def test_lloyd_equals_numpy_for_any_partitioning(points_df, partitions):
    x = blobs()
    df = points_df(x).repartition(partitions)
    seeds = kmeans.first_rows(df, 4, ["id"])
    np.testing.assert_allclose(seeds, x[:4])
    np.testing.assert_allclose(kmeans.lloyd(df, seeds, 5).matrix, numpy_lloyd(x, x[:4], 5))


def test_cost_does_not_rise_and_empty_cluster_stays(points_df):
    df = points_df(blobs())
    seeds = np.array([[0.0, 0.0], [1.0, 1.0], [1e6, 1e6]])
    costs = [kmeans.lloyd(df, seeds, n).cost for n in range(1, 6)]
    assert all(a >= b for a, b in zip(costs, costs[1:]))
    assert kmeans.lloyd(df, seeds, 3).matrix[2].tolist() == [1e6, 1e6]


def test_library_training_keeps_the_best_run(points_df):
    x = blobs()
    best = kmeans.train(points_df(x), 3, runs=3, tol=1e-6)
    assigned = best.assign(points_df(x))
    assert kmeans.within_cost(assigned).first().wssse == pytest.approx(best.cost, rel=1e-6)
    assert sorted(r.n for r in kmeans.cluster_sizes(assigned).collect()) == [200, 200, 200]


def test_entropy(spark):
    rows = [(0, "a")] * 2 + [(0, "b")] * 2 + [(1, "a")] * 4
    df = spark.createDataFrame(rows, "cluster int, label string")
    assert kmeans.mean_entropy(df).first().score == pytest.approx(np.log(2) / 2)


def test_sweep_gives_every_k_and_the_best(points_df):
    df = points_df(blobs())
    found = kmeans.sweep(
        df, [2, 3], lambda rows, k: kmeans.train(rows, k, seed=3), kmeans.mean_distance, parallel=2
    )
    assert {r.k for r in found.scores.collect()} == {2, 3}
    assert found.best_k() == 3
    assert found.best().k == 3


def test_class_counts_majority_and_impurity(spark):
    rows = [(0, "n")] * 9 + [(0, "a")] + [(1, "n")] * 2 + [(1, "a")] * 2 + [(2, "a")] * 3
    df = spark.createDataFrame(rows, "cluster int, label string")
    counts = labelling.class_counts(df, 5, F.col("label") == "n")
    assert sorted(map(tuple, counts.collect())) == [(0, 9, 1), (1, 2, 2), (2, 0, 3), (3, 0, 0), (4, 0, 0)]
    classes = {r.cluster: r.cluster_class for r in labelling.majority(counts).collect()}
    assert classes == {0: "normal", 1: None, 2: "attack", 3: None, 4: None}
    assert [r.cluster for r in labelling.impure(counts).collect()] == [1]
    assert sorted(r.cluster for r in labelling.impure(counts, force=[2]).collect()) == [1, 2]


def test_second_level_splits_the_impure_cluster(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 0.1, (50, 2)), rng.normal((2, 0), 0.1, (50, 2)), rng.normal(50, 0.1, (50, 2))])
    rows = [(i, "normal." if i < 50 or i >= 100 else "bad.", [float(v) for v in p]) for i, p in enumerate(x)]
    rows = [rows[i] for i in np.random.default_rng(1).permutation(150)]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "id long, label string, features array<double>")
    centers = kmeans.Centers(np.array([[1.0, 0.0], [50.0, 50.0]]))
    layout = Layout(())
    model, top = fit_two_level(df, centers, layout, 2, 10)
    assert list(model.sub) == [0]
    assigned = model.assign(df)
    sub = labelling.sub_classes(assigned, layout.is_normal())
    judged = labelling.attach_two_level_class(assigned, top, sub)
    wrong = judged.filter((F.col("cluster_class") == "normal") != layout.is_normal())
    assert wrong.count() == 0
    assert judged.filter("cluster = 1 and sub is not null").count() == 0


@pytest.mark.parametrize("ascending", [True, False])
def test_order_statistic_is_exact(spark, ascending, monkeypatch):
    monkeypatch.setattr(threshold, "_SORT_AT_MOST", 50)
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.exponential(size=4000), np.full(3000, 1.25), np.full(500, 0.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(6)
    ordered = np.sort(values) if ascending else np.sort(values)[::-1]
    for rank in (1, 40, 700, 3000, 5000, 7400, 7500):
        assert threshold.order_statistic(df, "s", rank, ascending) == ordered[rank - 1]
    with pytest.raises(ValueError):
        threshold.order_statistic(df, "s", 7501, ascending)


@pytest.mark.parametrize("limit", [50, 50_000])
def test_percent_positions(spark, monkeypatch, limit):
    monkeypatch.setattr(threshold, "_SORT_AT_MOST", limit)
    df = spark.createDataFrame([(float(v),) for v in range(1, 1051)], "s double")
    assert threshold.percent_position(df, "s", 2) == 21
    assert threshold.percent_position(df, "s", 98) == 1029
    assert threshold.percent_position(df, "s", 98, ascending=False) == 22
    assert threshold.percent_position(df, "s", 2, ascending=False, zero_based=True) == 1029
    assert threshold.nth_largest(df, "s", 100) == 951


def test_centroid_factor_against_plain_python(points_df):
    rng = np.random.default_rng(10)
    centers, x, sizes, k = rng.normal(size=(12, 3)), rng.normal(size=(30, 3)), rng.integers(1, 50, 12), 4

    def near(p):
        d = np.sqrt(((centers - p) ** 2).sum(axis=1))
        order = sorted(range(12), key=lambda i: (d[i], i))[:k]
        return order, d

    kdist = [near(c)[1][near(c)[0][-1]] for c in centers]

    def density(p):
        order, d = near(p)
        return k / sum(max(kdist[o], d[o]) for o in order)

    def factor(p, weighted):
        order, _ = near(p)
        share = [sizes[o] / sum(sizes[q] for q in order) if weighted else 1.0 for o in order]
        return sum(w * density(centers[o]) / density(p) for w, o in zip(share, order)) / k

    for weighted in (False, True):
        model = centroid_lof.fit(centers, k, sizes if weighted else None)
        out = model.score(points_df(x)).orderBy("id").collect()
        np.testing.assert_allclose([r.lof for r in out], [factor(p, weighted) for p in x])
    assert out[0].neighbours == near(x[0])[0]
