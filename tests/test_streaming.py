"""Streaming k-means: folds, replays, snapshots, feedback."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.streaming import online_kmeans as online

ONCE = {"availableNow": True}


def write_csv(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(",".join(map(repr, map(float, r))) for r in rows) + "\n")


def numpy_fold(centers, weights, batch, decay=1.0):
    centers, weights = centers.copy(), weights * decay
    index = ((batch[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    for i in range(len(centers)):
        mine = batch[index == i]
        if len(mine):
            centers[i] = (centers[i] * weights[i] + mine.sum(axis=0)) / (weights[i] + len(mine))
            weights[i] += len(mine)
    return centers, weights


@pytest.mark.parametrize("decay", [1.0, 0.5])
def test_stream_equals_the_fold_of_its_batches(spark, tmp_path, decay):
    rng = np.random.default_rng(0)
    batches = [rng.normal(size=(40, 3)) for _ in range(3)]
    start = rng.normal(size=(4, 3))
    state = online.State(spark, str(tmp_path / "state"))
    state.start(start)
    expected = [(start, np.zeros(4))]
    for i, batch in enumerate(batches):
        write_csv(tmp_path / "in", f"{i}.csv", batch)
        stream = online.training_stream(spark, str(tmp_path / "in"), 3)
        online.train_on(stream, state, str(tmp_path / "checkpoint"), decay, ONCE).awaitTermination()
        expected.append(numpy_fold(*expected[-1], batch, decay))
    assert state.latest_version() == 3
    for version, (centers, weights) in enumerate(expected):
        found = state.read(version)
        np.testing.assert_allclose(found[0], centers)
        np.testing.assert_allclose(found[1], weights)
    np.testing.assert_allclose(state.snapshot().matrix, expected[-1][0])
    assert state.history().count() == 16


def test_a_batch_run_twice_gives_the_same_state(spark, tmp_path, points_df):
    state = online.State(spark, str(tmp_path / "state"))
    state.start(np.array([[0.0, 0.0], [5.0, 5.0]]))
    batch = points_df(np.random.default_rng(1).normal(2, 2, size=(50, 2)))
    once = online.fold(*state.read(0), batch)
    state._write(1, *once)
    state._write(1, *online.fold(*state.read(0), batch))
    np.testing.assert_allclose(state.read(1)[0], once[0])


def test_random_start(spark, tmp_path):
    state = online.State(spark, str(tmp_path / "state"))
    state.start_random(6, 4, seed=2)
    centers, weights = state.read(0)
    assert centers.shape == (6, 4) and not weights.any()


def test_scores_outcomes_and_feedback(spark, tmp_path):
    state = online.State(spark, str(tmp_path / "state"))
    state.start(np.array([[0.0, 0.0], [10.0, 10.0]]), np.ones(2))
    rows = [(0, 0.1, 0.1), (0, 5.0, 5.0), (1, 10.2, 10.0), (1, 100.0, 100.0)]
    write_csv(tmp_path / "test", "a.csv", rows)
    for _ in range(2):  # the second run finds nothing new
        stream = online.testing_stream(spark, str(tmp_path / "test"), 2)
        online.score_on(
            stream, state, str(tmp_path / "c"), str(tmp_path / "out"), str(tmp_path / "back"), 1.0, trigger=ONCE
        ).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out") + "/b*")
    assert sorted((r.features[0], r.outcome) for r in found.collect()) == [
        (0.1, "TN"),
        (5.0, "FP"),
        (10.2, "FN"),
        (100.0, "TP"),
    ]
    stream = online.training_stream(spark, str(tmp_path / "back") + "/*", 2)
    online.train_on(stream, state, str(tmp_path / "c2"), trigger=ONCE).awaitTermination()
    assert state.read(1)[1].tolist() == [2.0, 2.0]


def test_malformed_streamed_row_stops_the_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1.0,2.0\n1.0,x\n")
    state = online.State(spark, str(tmp_path / "state"))
    state.start(np.zeros((1, 2)))
    query = online.train_on(
        online.training_stream(spark, str(tmp_path / "in"), 2), state, str(tmp_path / "c"), trigger=ONCE
    )
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        query.awaitTermination()
    assert state.latest_version() == 0


def test_label_first(spark):
    df = spark.createDataFrame([(["1.0", "2.5", "3.5"],)], "fields array<string>")
    label, features = online.label_first(F.col("fields"))
    assert tuple(df.select(label.alias("l"), features.alias("f")).first()) == (1.0, [2.5, 3.5])


@pytest.mark.parametrize("unit", ["batches", "points"])
def test_a_dying_center_splits_the_heaviest(spark, tmp_path, unit):
    rng = np.random.default_rng(4)
    batches = [rng.normal(size=(n, 2)) for n in (30, 1, 50)]
    decay = online.half_life(20)
    start, state = np.array([[0.0, 1.0], [-1.0, 0.0], [1e6, 1e6]]), online.State(spark, str(tmp_path / "state"))
    state.start(start)
    expected = start, np.zeros(3)
    for i, batch in enumerate(batches):
        write_csv(tmp_path / "in", f"{i}.csv", batch)
        stream = online.training_stream(spark, str(tmp_path / "in"), 2)
        online.train_on(stream, state, str(tmp_path / "c"), decay, ONCE, unit, nudge=0.1).awaitTermination()
        centers, weights = numpy_fold(*expected, batch, decay if unit == "batches" else decay ** len(batch))
        if i == 0:  # the far one has no row; no later batch leaves one that light
            heavy = weights.argmax()
            assert weights[2] == 0
            apart = 0.1 * np.maximum(abs(centers[heavy]), 1)
            centers[2], centers[heavy] = centers[heavy] - apart, centers[heavy] + apart
            weights[2] = weights[heavy] = weights[heavy] / 2
        expected = centers, weights
        np.testing.assert_allclose(state.read(i + 1)[0], centers)
        np.testing.assert_allclose(state.read(i + 1)[1], weights)
    assert online.split_dying(*expected)[0] is expected[0]
    assert {r.version for r in state.dumps(40).collect()} == {3}
    assert {r.version for r in state.dumps(31).collect()} == {2, 3}


def test_old_versions_are_packed(spark, tmp_path):
    state = online.State(spark, str(tmp_path / "state"), pack=3)
    for version in range(9):
        state._write(version, np.full((2, 1), float(version)), np.ones(2))
    state._write(8, np.full((2, 1), 8.0), np.ones(2))  # a batch run again
    assert sorted(p.name for p in (tmp_path / "state").glob("v*")) == ["v6", "v7", "v8"]
    assert sorted(p.name for p in (tmp_path / "state" / "log").iterdir()) == ["c0", "c1"]
    assert [state.read(v)[0][0, 0] for v in range(9)] == [float(v) for v in range(9)]
    assert sorted(r.version for r in state.history().collect()) == sorted([*range(9)] * 2)
    state._pack_up(1)  # as after a failure between the table and the clearing
    assert state.history().count() == 18 and state.latest_version() == 8


def test_the_newest_of_a_thousand_versions_is_found_at_once(spark, tmp_path, monkeypatch):
    state = online.State(spark, str(tmp_path / "state"), pack=5000)
    state.start(np.zeros((1, 1)))
    for version in range(1, 1000):
        folder = tmp_path / "state" / f"v{version}"
        folder.mkdir()
        (folder / "_SUCCESS").touch()
    state._write(1000, np.ones((1, 1)), np.ones(1))
    looked, is_complete = [], online._is_complete
    monkeypatch.setattr(online, "_is_complete", lambda s, folder: looked.append(folder) or is_complete(s, folder))
    assert state.latest_version() == 1000 and len(looked) == 1
    assert state.snapshot().matrix.tolist() == [[1.0]] and len(looked) <= 4
    (tmp_path / "state" / "LATEST").write_text("")  # caught while it is written
    (tmp_path / "state" / ".LATEST.crc").unlink(missing_ok=True)
    assert state.latest_version() == 1000


def test_windowed_outcomes_with_late_rows_and_a_batch_run_again(spark, tmp_path):
    from farpoint.operators.kmeans import Centers

    centers = Centers(np.array([[0.0]]))
    schema = "label double, features array<double>, time timestamp"

    def arrive(name, rows):
        df = spark.createDataFrame(rows, "label double, features array<double>, time string")
        df.withColumn("time", F.to_timestamp("time")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in") + "/*")
        online.windowed_outcomes_on(
            stream, centers, str(tmp_path / "c"), str(tmp_path / "out"), "1 hour", "2 hours", threshold=1.0, trigger=ONCE
        ).awaitTermination()
        found = online.windowed_outcomes(spark, str(tmp_path / "out"))
        rows = found.select(F.date_format("start", "HH:mm").alias("at"), "outcome", "n").collect()
        return sorted((r.at, r.outcome, r.n) for r in rows)

    arrive("a", [(0.0, [0.1], "2024-01-01 06:10:00"), (1.0, [5.0], "2024-01-01 06:20:00"), (0.0, [0.2], "2024-01-01 09:30:00")])
    assert run() == [("06:00", "TN", 1), ("06:00", "TP", 1), ("09:00", "TN", 1)]
    # the mark is 07:30: a row of 07:40 is late and counts, one of 06:30 comes too late; one has no time
    arrive("b", [(0.0, [0.3], "2024-01-01 07:40:00"), (0.0, [0.3], "2024-01-01 06:30:00"), (0.0, [9.0], "2024-01-01 09:40:00"), (0.0, [0.1], None)])
    after = [("06:00", "TN", 1), ("06:00", "TP", 1), ("07:00", "TN", 1), ("09:00", "FP", 1), ("09:00", "TN", 1)]
    assert run() == after
    # the stream ends before it has noted its last batches: they are run again
    for commit in sorted((tmp_path / "c" / "commits").glob("*[0-9]"), key=lambda p: int(p.name))[-2:]:
        commit.unlink()
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    assert run() == after
