"""What one task reads of a table of many files, which Spark packs into few tasks."""

import pytest

from farpoint import session
from farpoint.catalog import QUERIES
from farpoint.plans import detectors

SMALL = "/root/testdata/sf0.001/lineitem.parquet"


def _stored(df, path, files):
    df.repartition(files).write.mode("append").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def _limits(monkeypatch, rows, packed):
    monkeypatch.setattr(session, "ROWS_PER_TASK", rows)
    monkeypatch.setattr(session, "PACKED_ROWS", packed)


def _most(df):
    return max(df.rdd.glom().map(len).collect())


def test_packed_files_are_dealt_out(spark, tmp_path, monkeypatch):
    _limits(monkeypatch, 500, 1000)
    packed = _stored(spark.range(20_000), tmp_path / "even", 40)
    assert _most(packed) > 1000
    dealt = session.spread(packed)
    assert _most(dealt) <= 600 and dealt.selectExpr("sum(id)").first()[0] == 20_000 * 19_999 // 2


def test_one_long_file_among_short_ones(spark, tmp_path, monkeypatch):
    _limits(monkeypatch, 500, 3000)
    _stored(spark.range(10_000), tmp_path / "uneven", 1)
    uneven = _stored(spark.range(10_000, 11_000), tmp_path / "uneven", 40)
    assert len(uneven.inputFiles()) == 41
    dealt = session.spread(uneven)
    assert _most(dealt) <= 600 and dealt.count() == 11_000


def test_empty_table(spark):
    assert session.spread(spark.range(0)).count() == 0


@pytest.mark.parametrize("name", ["detector_projected_majority", "detector_scaled_majority", "features_center_distances", "detector_encoded_distance"])
def test_queries_hold_no_more_of_packed_files(spark, tmp_path, monkeypatch, name):
    _limits(monkeypatch, 300, 600)
    _stored(spark.read.parquet(SMALL), tmp_path / "lineitem.parquet", 24)
    fitted, most = detectors._fitted, []

    def watched(chain, rows):
        found = fitted(chain, rows)
        most.append(_most(found))
        return found

    monkeypatch.setattr(detectors, "_fitted", watched)
    QUERIES[name](spark, str(tmp_path)).collect()
    assert len(most) == 1 and most[0] <= 400
