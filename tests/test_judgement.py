"""Evaluation arithmetic and the one-class SVM."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.operators import evaluate, ocsvm


def test_outcomes_for_both_positives(spark):
    df = spark.createDataFrame(
        [(True, True), (False, True), (False, False), (True, False), (True, None)], "n boolean, j boolean"
    )
    normal = [r.o for r in df.select(evaluate.outcome(F.col("n"), F.col("j")).alias("o")).collect()]
    attack = [r.o for r in df.select(evaluate.outcome(F.col("n"), F.col("j"), "attack").alias("o")).collect()]
    assert normal == ["TP", "FP", "TN", "FN", "noclass"]
    assert attack == ["TN", "FN", "TP", "FP", "noclass"]


def test_score_on_the_threshold_has_no_class(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "s double")
    assert [r.j for r in df.select(evaluate.judged_by_score(F.col("s"), 2.0).alias("j")).collect()] == [True, None, False]


# Recorded counts and rates: tp, fp, tn, fn, precision, recall, accuracy.
GOLDEN = [
    (57685, 18969, 231467, 2906, 0.75253737, 0.95203906, 0.9296685),
    (27395, 1386, 249050, 33196, 0.9518432, 0.45212984, 0.8888135),
    (33234, 32634, 217802, 27357, 0.50455457, 0.5484973, 0.80711967),
    (57776, 18760, 231676, 2815, 0.75488657, 0.953541, 0.930633),
    (41298, 2000, 248413, 19280, 0.9538085, 0.68173265, 0.93157357),
    (51364, 89821, 142137, 27711, 0.363806367, 0.649560544, 0.622123697),
]


def test_recorded_rates(spark):
    df = spark.createDataFrame([g[:4] for g in GOLDEN], "tp long, fp long, tn long, fn long")
    found = {r.tp: (r.precision, r.recall, r.accuracy) for r in evaluate.rates(df).collect()}
    for tp, _, _, _, *rates in GOLDEN:
        np.testing.assert_allclose(found[tp], rates, atol=1e-6)


def test_rates_of_nothing_are_null(spark):
    df = spark.createDataFrame([(0, 0, 5, 0)], "tp long, fp long, tn long, fn long")
    row = evaluate.rates(df).first()
    assert (row.precision, row.recall, row.accuracy) == (None, None, 1.0)


def test_confusion_adds_up_and_grid_matches_single_thresholds(spark):
    rng = np.random.default_rng(0)
    rows = [(float(s), bool(n)) for s, n in zip(rng.uniform(size=500), rng.integers(0, 2, 500))]
    df = spark.createDataFrame(rows, "s double, n boolean").repartition(5)
    grid = {r.epsilon: r for r in evaluate.threshold_grid(df, F.col("s"), F.col("n"), [0.2, 0.7]).collect()}
    for epsilon, row in grid.items():
        single = df.withColumn("outcome", evaluate.outcome(F.col("n"), F.col("s") < epsilon))
        counts = evaluate.confusion(single).first()
        assert (row.tp, row.fp, row.tn, row.fn) == (counts.tp, counts.fp, counts.tn, counts.fn)
        assert counts.tp + counts.fp + counts.tn + counts.fn == 500


def test_run_reports_roll_up_and_ignore_other_text(spark, tmp_path):
    df = spark.createDataFrame([("a", *GOLDEN[0][:4]), ("b", *GOLDEN[1][:4])], "name string, tp long, fp long, tn long, fn long")
    path = str(tmp_path / "runs")
    evaluate.write_run_reports(df, path, F.col("name"))
    noise = spark.createDataFrame([("a", "precision is : 0"), ("a", "TP was unclear")], "run string, value string")
    noise.write.partitionBy("run").mode("append").text(path)
    rows = {r.run: r for r in evaluate.rollup_reports(spark.read.text(path)).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].tp, rows["a"].fn) == (57685, 2906)
    assert rows["b"].accuracy == pytest.approx(0.8888135, abs=1e-6)


def test_decimal_counters_are_read(spark):
    lines = ["TP is:51364.0", "FP is:89821.0", "TN is:142137.0", "FN is:27711.0"]
    df = spark.createDataFrame([("10_10_200000", v) for v in lines], "run string, value string")
    assert evaluate.rollup_reports(df).first().recall == pytest.approx(0.6495605)


def test_support_vector_scores_both_ways(points_df, spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, sv, alpha = rng.normal(size=(60, 2)), rng.normal(size=(25, 2)), rng.uniform(size=25)
    support = spark.createDataFrame([([float(v) for v in c], float(a)) for c, a in zip(sv, alpha)], "center array<double>, alpha double")
    expected = (np.exp(-0.5 * ((x[:, None] - sv[None]) ** 2).sum(axis=2)) * alpha).sum(axis=1) - 2.0
    monkeypatch.setattr(ocsvm, "_CHUNK_ROWS", 20)
    for size in (1 << 20, 200):
        out = ocsvm.score_support_vectors(points_df(x), support, -0.5, 2.0, model_bytes=size).orderBy("id").collect()
        np.testing.assert_allclose([r.score for r in out], expected)
        assert [r.accepted for r in out] == (expected > 0).tolist()


def test_support_vector_scores_of_repeated_and_missing_keys(spark):
    """Keys play no part in the sums, on either side of the size switch."""
    x = [[0.0, 0.1], [0.5, 0.2], [0.5, 0.2], [1.0, -1.0], [0.3, 0.3]]
    rows = spark.createDataFrame(list(zip([1, 1, 2, None, None], x, range(5))), "id long, features array<double>, _row int").repartition(3)
    sv = [[0.0, 0.0], [1.0, 1.0], [0.2, -0.4]]
    support = spark.createDataFrame([(c,) for c in sv], "center array<double>")
    expected = np.exp(-((np.array(x)[:, None] - np.array(sv)[None]) ** 2).sum(axis=2)).sum(axis=1)
    for size in (1 << 20, 40):
        out = ocsvm.score_support_vectors(rows, support, model_bytes=size)
        assert out.columns == ["id", "features", "_row", "score", "accepted"]
        out = out.orderBy("_row").collect()
        assert [r.id for r in out] == [1, 1, 2, None, None]
        np.testing.assert_allclose([r.score for r in out], expected)


def test_unit_weights_on_single_numbers(points_df, spark):
    support = spark.createDataFrame([([0.0],), ([1.0],)], "center array<double>")
    out = ocsvm.score_support_vectors(points_df(np.array([[0.0]])), support, rho=1.0).first()
    assert out.score == pytest.approx(np.exp(-1.0))


def test_one_class_training_rejects_nu_and_outliers(points_df):
    rng = np.random.default_rng(2)
    train = rng.normal(size=(1000, 2))
    model = ocsvm.train(points_df(train).repartition(4), nu=0.1, gamma=0.3, components=128, steps=15)
    accepted = model.score(points_df(train)).filter("accepted").count()
    assert accepted == pytest.approx(900, abs=2)
    far = np.array([[8.0, 8.0], [-9.0, 0.0], [0.0, 10.0]])
    assert model.score(points_df(far)).filter("accepted").count() == 0
    assert model.score(points_df(np.zeros((1, 2)))).filter("accepted").count() == 1
