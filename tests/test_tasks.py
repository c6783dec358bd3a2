"""What one task reads of a table that is dealt out, as the table grows."""

from farpoint import session


def _stored(spark, tmp_path, rows, files):
    path = str(tmp_path / f"rows-{rows}-{files}.parquet")
    spark.range(0, rows, 1, files).write.parquet(path)
    return spark.read.parquet(path)


def test_a_task_reads_no_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    for rows in (8_000, 32_000):
        dealt = session.spread(_stored(spark, tmp_path, rows, 1))
        per_task = dealt.rdd.glom().map(len).collect()
        assert sum(per_task) == rows and max(per_task) <= 600
        assert dealt.selectExpr("sum(id)").first()[0] == rows * (rows - 1) // 2


def test_many_large_files_and_small_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    assert session.spread(_stored(spark, tmp_path, 100, 1)).rdd.getNumPartitions() == 8
    assert max(session.spread(_stored(spark, tmp_path, 20_000, 10)).rdd.glom().map(len).collect()) <= 600
    enough = _stored(spark, tmp_path, 20_000, 40)
    assert session.spread(enough) is enough
