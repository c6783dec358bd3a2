"""Tables whose scan is enough for single passes: dealt out are only the rows that a fit keeps."""

import pytest

from farpoint import session
from farpoint.catalog import QUERIES
from farpoint.plans import detectors

SMALL = "/root/testdata/sf0.001/lineitem.parquet"


def _stored(df, path, files):
    df.repartition(files).write.mode("append").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def _most(df):
    return max(df.rdd.glom().map(len).collect())


def _shuffled(df):
    return "Exchange RoundRobin" in df._jdf.queryExecution().toString()


def test_rows_a_fit_keeps_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    packed = _stored(spark.range(7_000), tmp_path / "packed", 40)
    assert 500 < _most(packed) <= session.PACKED_ROWS
    dealt = session.dealt(packed)
    assert _most(dealt) <= 600 and dealt.selectExpr("sum(id)").first()[0] == 7_000 * 6_999 // 2
    assert session.dealt(dealt) is dealt and session.dealt(spark.range(0)).count() == 0


def test_scans_with_work_for_all_cores_are_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(session, "PACKED_ROWS", 1000)
    packed = _stored(spark.range(20_000), tmp_path / "packed", 40)
    assert session.scanned(packed) is packed
    for rows, files in ((20_000, 1), (0, 1)):
        found = session.scanned(_stored(spark.range(rows), tmp_path / f"one-{rows}", files))
        assert _shuffled(found) and found.count() == rows
    uneven = _stored(spark.range(20_000), tmp_path / "uneven", 40)
    uneven = _stored(spark.range(20_000, 60_000), tmp_path / "uneven", 1)
    found = session.scanned(uneven)
    assert _most(found) <= 600 and found.count() == 60_000


@pytest.mark.parametrize("name", ["detector_scaled_majority", "features_center_distances", "detector_encoded_distance"])
def test_queries_deal_out_what_their_fit_keeps(spark, tmp_path, monkeypatch, name):
    """24 files, 750 lines a task: no more than 1000, but more than a fit is to keep."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(session, "PACKED_ROWS", 1000)
    _stored(spark.read.parquet(SMALL), tmp_path / "lineitem.parquet", 24)
    fitted, seen = detectors._fitted, []

    def watched(chain, rows):
        found = fitted(chain, rows)
        seen.append((_shuffled(rows), _most(found)))
        return found

    monkeypatch.setattr(detectors, "_fitted", watched)
    QUERIES[name](spark, str(tmp_path)).collect()
    [(shuffled, most)] = seen
    assert not shuffled and most <= 400
