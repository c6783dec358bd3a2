"""One-class SVM on landmarks: the dual's optimum, the scores of its support table, the rejected share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.operators import ocsvm


def test_the_dual_is_solved():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2))
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    cap = rng.dirichlet(np.ones(30)) / 0.3
    alpha = ocsvm._solve(kernel, cap)
    assert alpha.sum() == pytest.approx(1) and (alpha >= 0).all() and (alpha <= cap + 1e-12).all()
    # no feasible point is better
    best = alpha @ kernel @ alpha
    for _ in range(2000):
        other = np.minimum(cap, rng.dirichlet(np.full(30, 0.5)))
        room = cap - other
        other += room * (1 - other.sum()) / room.sum()
        mixed = 0.9 * alpha + 0.1 * other
        assert mixed @ kernel @ mixed >= best - 1e-9


def test_scores_are_those_of_the_support_table(points_df):
    rng = np.random.default_rng(2)
    train = np.concatenate([rng.normal(size=(380, 2)), 40 + rng.normal(size=(20, 2))])  # a small region of its own
    model = ocsvm.train_landmarks(points_df(train), nu=0.02, gamma=0.2, scale=False, landmarks=40)
    out = np.array([r.score for r in model.score(points_df(train)).orderBy("id").collect()])
    gaps = ((train[:, None] - model.centers[None]) ** 2).sum(axis=2)
    np.testing.assert_allclose(out, np.exp(-0.2 * gaps) @ model.alpha - model.rho, atol=1e-9)
    assert (out <= 0).sum() == 8
    far = model.score(points_df(np.array([[20.0, 20.0], [40.0, 40.0], [0.0, 0.0]]))).orderBy("id").collect()
    assert [r.accepted for r in far] == [False, True, True]


def test_scaled_rows_repeats_and_clashing_names(points_df):
    rng = np.random.default_rng(3)
    train = rng.normal(size=(200, 2)) * [1.0, 1000.0]
    train[:50] = train[0]
    model = ocsvm.train_landmarks(points_df(train), nu=0.1, landmarks=16)
    df = points_df(train).withColumn("_scaled", F.lit(7))
    scored = model.score(df)
    assert scored.columns == [*df.columns, "score", "accepted"]
    assert scored.filter("not accepted").count() <= 20 and scored.filter("id = 0 and accepted").count() == 1


def test_few_rows_and_wrong_arguments(points_df):
    model = ocsvm.train_landmarks(points_df(np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 1.0]])), nu=0.5, scale=False, landmarks=64)
    assert model.alpha.sum() == pytest.approx(1)
    with pytest.raises(ValueError, match="no rows"):
        ocsvm.train_landmarks(points_df(np.array([[0.0]])).limit(0), scale=False)
    with pytest.raises(ValueError, match="landmarks"):
        ocsvm.train_landmarks(points_df(np.eye(2)), landmarks=5000)
