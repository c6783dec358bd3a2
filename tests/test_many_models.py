"""k-means over many models in the same scans, against the same steps in plain numpy."""

import hashlib

import numpy as np
import pytest

from farpoint.operators import kmeans


def _digest(run, step, i):
    return hashlib.md5(f"{run}-{step}-{i}".encode()).hexdigest()


def _random(x, k, run):
    return x[sorted(range(len(x)), key=lambda i: _digest(run, 0, i))[:k]]


def _squares(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(axis=2)


def _parallel(x, k, run, steps=2):
    drawn = _random(x, 1, run)
    for step in range(1, steps + 1):
        d = _squares(x, drawn).min(axis=1)
        share = np.array([int(_digest(run, step, i)[:8], 16) / 2**32 for i in range(len(x))])
        drawn = np.vstack([drawn, x[share * d.sum() < 2.0 * k * d]])
    weights = np.bincount(_squares(x, drawn).argmin(axis=1), minlength=len(drawn))
    taken = [int(weights.argmax())]
    while len(taken) < k:
        taken.append(int((weights * _squares(drawn, drawn[taken]).min(axis=1)).argmax()))
    return drawn[taken]


def _lloyd(x, centers, rounds):
    for _ in range(rounds):
        near = _squares(x, centers).argmin(axis=1)
        centers = np.array([x[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
    return centers, _squares(x, centers).min(axis=1).sum()


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    return np.vstack([rng.normal(c, 0.5, size=(60, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0), (0, 0, 6))])


@pytest.mark.parametrize("init, brute", [("random", _random), ("k-means||", _parallel)])
def test_restarts_and_sweeps_equal_numpy(points_df, points, init, brute):
    ks = [4, 4, 4, 2, 7]  # restarts and a sweep in one go
    models = kmeans.train_together(points_df(points).repartition(5), ks, ["id"], 6, init, seed=3)
    for run, (k, model) in enumerate(zip(ks, models)):
        centers, cost = _lloyd(points, brute(points, k, 3 + run), 6)
        np.testing.assert_allclose(model.matrix, centers)
        assert model.cost == pytest.approx(cost)
    best = kmeans.best_of(models[:3])
    assert best.cost == min(m.cost for m in models[:3])
    scores = {r.model: (r.k, r.score) for r in kmeans.mean_distances(points_df(points), models).collect()}
    for run, (k, model) in enumerate(zip(ks, models)):
        assert scores[run] == (k, pytest.approx(np.sqrt(_squares(points, model.matrix).min(axis=1)).mean()))


@pytest.mark.parametrize("init", ["random", "k-means||"])
def test_scans_do_not_grow_with_runs(spark, points_df, points, init, monkeypatch):
    df = points_df(points).repartition(3).persist()
    counted = []
    sums, seeds = kmeans.model_sums, kmeans.vectors.nearest_distances
    monkeypatch.setattr(kmeans, "model_sums", lambda rows, models: counted.append(len(models)) or sums(rows, models))
    monkeypatch.setattr(kmeans.vectors, "nearest_distances", lambda c, models: counted.append(len(models)) or seeds(c, models))
    scans = []
    for runs in (1, 6):
        counted.clear()
        kmeans.train_together(df, [4] * runs, ["id"], 3, init)
        scans.append(len(counted))
        assert counted[-1] == runs
    assert scans[0] <= scans[1] <= scans[0] + 3  # no more than a round for each of the iterations asked for


def test_too_few_rows_and_copies(points_df):
    with pytest.raises(ValueError, match="seeds wanted"):
        kmeans.train_together(points_df(np.zeros((2, 1))), [3], ["id"])
    # two different points only: k-means|| draws no third, random rows fill up
    [model] = kmeans.train_together(points_df(np.array([[0.0]] * 5 + [[1.0]] * 5)), [3], ["id"], 2)
    assert model.k == 3 and model.cost == 0.0
