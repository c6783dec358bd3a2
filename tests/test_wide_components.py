"""Subspace iteration against the eigenvectors of the whole covariance."""

import numpy as np
import pytest

from farpoint.operators import pca


def test_components_and_shares(points_df, monkeypatch):
    monkeypatch.setattr(pca, "_LINES", 7)  # the product travels in several rows
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 20)) * np.linspace(3, 0.5, 20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0] + 1000
    values, axes = np.linalg.eigh(np.cov(x.T))
    model = pca.fit_wide_components(points_df(x).repartition(5), 3, centered=True, passes=200)
    np.testing.assert_allclose(np.abs((model.matrix * axes[:, ::-1][:, :3]).sum(axis=0)), 1, atol=1e-9)
    np.testing.assert_allclose(model.variance_share, values[::-1][:3] / values.sum(), rtol=1e-6)
    np.testing.assert_allclose(model.mean, x.mean(axis=0))
    assert (model.matrix[np.abs(model.matrix).argmax(axis=0), range(3)] > 0).all()


def test_constant_rows_and_wrong_sizes(points_df):
    model = pca.fit_wide_components(points_df(np.ones((5, 4))), 2)
    assert model.variance_share.tolist() == [0, 0]
    np.testing.assert_allclose(model.matrix.T @ model.matrix, np.eye(2), atol=1e-12)
    with pytest.raises(ValueError):
        pca.fit_wide_components(points_df(np.ones((5, 4))), 5)


def test_directions_that_do_not_come_to_rest_are_told(points_df):
    x = np.random.default_rng(6).normal(size=(50, 6))
    with pytest.warns(UserWarning, match="still turn"):
        pca.fit_wide_components(points_df(x), 1, spare=0, passes=2)
