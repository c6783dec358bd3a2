"""What detectors keep for a trainer."""

import pytest

from farpoint.plans import detectors
from farpoint.plans.features import Layout, from_first_rows

LAYOUT = Layout(("a", "b"))


@pytest.mark.parametrize("fit", ["majority", "distances", "normal"])
def test_only_key_and_features_are_held(spark, fit):
    rows = [(i, float(i % 7), float(i % 5), "normal." if i % 3 else "odd.", "x" * 50) for i in range(60)]
    df, seen = spark.createDataFrame(rows, "id long, a double, b double, label string, note string"), []

    def trainer(features, k):
        seen.append((features.columns, features.storageLevel.useMemory))
        return from_first_rows(2)(features, k)

    if fit == "majority":
        detectors.majority_detector(df, df, LAYOUT, pca_k=2, k=3, scaling="train", trainer=trainer)
    elif fit == "distances":
        [kept] = detectors.distance_features(df, [], LAYOUT, 2, 3, trainer=trainer)
        assert "note" in kept.columns
    else:
        detectors.distance_detector(df, df, LAYOUT, pca_k=2, k=3, trainer=trainer)
    assert seen == [(["id", "features"], True)]
