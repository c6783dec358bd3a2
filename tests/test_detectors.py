"""Detectors on small made-up connection records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.plans import detectors
from farpoint.plans.features import Layout, fit_features, from_first_rows

LAYOUT = Layout(("f0", "f4", "f5"), ("protocol",))
LLOYD = from_first_rows(6)


@pytest.fixture(scope="module")
def records(spark):
    """300 normal rows, 60 attacks of another protocol far away."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(360):
        attack = i % 6 == 5
        center = 20.0 if attack else 0.0
        values = [float(v) for v in rng.normal(center, 1.0, 3)]
        rows.append((i, values[0], "icmp" if attack else ("tcp", "udp")[i % 2], *values[1:], "smurf." if attack else "normal."))
    df = spark.createDataFrame(rows, "id long, f0 double, protocol string, f4 double, f5 double, label string").repartition(4)
    df.persist().count()
    return df.filter("id < 240"), df.filter("id >= 240")


def normal(df):
    return df.filter("label = 'normal.'")


def check(row, accuracy=0.95):
    assert row.tp + row.fp + row.tn + row.fn + row.noclass == 120
    assert row.accuracy >= accuracy


@pytest.mark.parametrize("scaling", [None, "train"])
def test_majority(records, scaling):
    train, test = records
    check(detectors.majority_detector(train, test, LAYOUT, pca_k=3, k=8, scaling=scaling, trainer=LLOYD).first())


def test_numeric_and_scaled_majority(records):
    train, test = records
    check(detectors.numeric_majority_detector(train, test, LAYOUT, pca_k=2, k=8, trainer=LLOYD).first())
    check(detectors.scaled_majority_detector(train, test, LAYOUT, pca_k=2, k=8, trainer=LLOYD).first())


def test_two_level(records):
    train, test = records
    check(detectors.two_level_detector(train, test, LAYOUT, pca_k=3, k=4, iterations=5, trainer=LLOYD).first())


def test_distance_detectors(records):
    train, test = records
    check(detectors.distance_detector(normal(train), test, LAYOUT, epsilon=100.0, pca_k=2, k=5, trainer=LLOYD).first())
    options = {"epsilon": 300.0, "pca_k": 3, "k": 5, "trainer": LLOYD}
    check(detectors.encoded_distance_detector(normal(train), test, train, LAYOUT, **options).first())
    table, cost = detectors.own_scaled_distance_detector(normal(train), test, train, LAYOUT, **{**options, "epsilon": 3.0})
    row = table.first()
    assert row.tp + row.fp + row.tn + row.fn == 120 and cost > 0


def test_cascade(records):
    train, test = records
    check(detectors.cascade_detector(train, normal(train), test, LAYOUT, 300.0, 3, 5, 6, normal_trainer=LLOYD, mixed_trainer=LLOYD).first())


def test_density_detectors(records):
    train, test = records
    for found in (
        detectors.outlier_degree_detector(normal(train), test, train, LAYOUT, 3, 6, 2.0, trainer=LLOYD),
        detectors.lof_detector(normal(train), test, train, LAYOUT, 3, 10, 3, trainer=LLOYD),
        detectors.lof_detector(normal(train), test, train, LAYOUT, 3, 10, 3, weighted=False, fixed_threshold=3.0, trainer=LLOYD),
    ):
        rows = found.select("label", "outcome").collect()
        assert len(rows) == 120
        assert all(r.outcome == "TN" for r in rows if r.label != "normal.")
        assert sum(r.outcome == "TP" for r in rows) >= 85


def test_two_stage_density(records):
    train, test = records
    halves = [normal(train).filter(F.col("id") % 4 < 2), normal(train).filter(F.col("id") % 4 >= 2)]
    found = detectors.two_stage_lof_detector(*halves, test, train, LAYOUT, 3, 8, 3, 5.0, trainer=LLOYD)
    rows = found.select("label", "outcome").collect()
    assert all(r.outcome == "TN" for r in rows if r.label != "normal.")
    assert sum(r.outcome == "TP" for r in rows) >= 75


def test_two_model_svm(records):
    train, test = records
    shifted = [df.withColumns({c: F.col(c) + 10 for c in LAYOUT.numeric}) for df in (normal(train), train, test)]
    found = detectors.two_model_svm(*shifted, LAYOUT, 2, 3, trainer=LLOYD, components=64, steps=10, gamma=0.5)
    rows = found.select("label", "outcome").collect()
    assert len(rows) == 120
    assert sum(r.outcome == "TN" for r in rows) >= 18


def test_threshold_sweep_covers_the_grid(records):
    train, test = records
    grid = detectors.threshold_sweep(normal(train), test, LAYOUT, (1.0, 50.0, 1e6), (1, 2), (2, 4), trainer=LLOYD)
    rows = grid.collect()
    assert {(r.pca, r.k, r.epsilon) for r in rows} == {(p, k, e) for p in (1, 2) for k in (2, 4) for e in (1.0, 50.0, 1e6)}
    assert all(r.tp + r.fp + r.tn + r.fn == 120 for r in rows)
    assert all(r.recall == 1.0 for r in rows if r.epsilon == 1e6)


def test_reports_keep_every_row(records):
    train, test = records
    report = detectors.cluster_label_report(train, test, LAYOUT, 4, trainer=LLOYD).collect()
    assert sum(r["count"] for r in report) == 120
    assert detectors.cluster_rows(train, LAYOUT, 3, LLOYD).select("label", "cluster", "protocol").count() == 240
    assert len(detectors.project_all(train, LAYOUT).first().features) == 3


def test_top_anomalies_are_the_attacks(records):
    train, _ = records
    found = detectors.top_anomalies(train, LAYOUT, k=1, n=30, limit=10, trainer=LLOYD).collect()
    assert len(found) == 10 and {r.label for r in found} == {"smurf."}


def test_distance_features_cover_all_sets(records):
    train, test = (df.withColumns({c: F.col(c) + 10 for c in LAYOUT.numeric}) for df in records)
    a, b = detectors.distance_features(train, [test], LAYOUT, 2, 5, trainer=LLOYD)
    assert (a.count(), b.count(), len(b.first().dists)) == (240, 120, 5)


def test_sweeps(records):
    train, _ = records
    assert {r.k for r in detectors.sweep_entropy(train, (2, 4), LAYOUT, LLOYD).scores.collect()} == {2, 4}
    sample = detectors.best_k_sample(train, LAYOUT, (2, 4), fraction=0.5, trainer=LLOYD).collect()
    assert sample and all(len(r.value.split(",")) == 4 for r in sample)


def test_one_chain_for_both_sides(records):
    train, test = records
    chain = fit_features(train, LAYOUT, scaling="train", pca_k=2)
    again = fit_features(train.repartition(7), LAYOUT, scaling="train", pca_k=2)
    a = [r.features for r in chain.transform(test).orderBy("id").collect()]
    b = [r.features for r in again.transform(test).orderBy("id").collect()]
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_exact_report(records):
    train, test = records
    vectors = [df.select("id", "label", F.array("f0", "f4", "f5").alias("features")) for df in (normal(train), test)]
    rows = detectors.exact_lof_report(*vectors).collect()
    assert [r.lof for r in rows] == sorted((r.lof for r in rows), reverse=True)
    assert all(r.outlier for r in rows if r.label != "normal.")
