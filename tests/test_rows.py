"""Scans, sinks, numbering and row shaping."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farpoint.operators import shape
from farpoint.sources import records


def connection_line(label="normal.", service="http", bad=None):
    numbers = [str(i) for i in range(4, 41)]
    if bad is not None:
        numbers[10] = bad
    return ",".join(["0", "tcp", service, "SF", *numbers, label])


@pytest.fixture()
def text_file(tmp_path):
    def write(lines, name="part.csv"):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return write


def test_fixed_values_have_their_sizes():
    assert (len(records.PROTOCOLS), len(records.SERVICES), len(records.STATES)) == (3, 70, 11)
    assert len(records.NUMERIC) + len(records.CATEGORICAL) + 1 == 42
    assert len(records.connection_schema()) == 42


def test_connection_records_are_read_by_position(spark, text_file):
    path = text_file([connection_line(), connection_line("smurf.", "ecr_i")])
    rows = records.read_delimited(spark, path, records.connection_schema()).orderBy("label").collect()
    assert [(r.service, r.f4, r.f40, r.label) for r in rows] == [
        ("http", 4.0, 40.0, "normal."),
        ("ecr_i", 4.0, 40.0, "smurf."),
    ]


def test_malformed_number_raises_or_becomes_null(spark, text_file):
    path = text_file([connection_line(bad="19)")])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        records.read_delimited(spark, path, records.connection_schema()).select("f14").collect()
    lenient = records.read_delimited(spark, path, records.connection_schema(), strict=False)
    assert lenient.select("f14").first().f14 is None


def test_strict_and_lenient_casts(spark):
    df = spark.createDataFrame([(["1", " 2.5", "x"],)], "fields array<string>")
    assert df.select(shape.to_doubles(F.col("fields"), strict=False).alias("v")).first().v == [1.0, 2.5, None]
    with pytest.raises(PySparkException):
        df.select(shape.to_doubles(F.col("fields"))).collect()


def test_line_numbers_follow_the_file_over_many_splits(spark, tmp_path):
    lines = [f"row-{i}" + "x" * (i % 37) for i in range(5000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:4000]) + "\n")
    (tmp_path / "in" / "b.txt").write_text("\n".join(lines[4000:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = records.read_numbered_lines(spark, str(tmp_path / "in"))
        assert df.rdd.getNumPartitions() > 8
        rows = df.orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == lines
    assert [r.line_no for r in rows] == list(range(1, 5001))


def test_row_ids_are_unique_and_stable(spark):
    df = records.with_row_id(spark.range(1000).select((F.col("id") % 7).alias("v")).repartition(5))
    first = sorted(map(tuple, df.select("id", "v").collect()))
    assert len({i for i, _ in first}) == 1000
    assert first == sorted(map(tuple, df.repartition(3).select("id", "v").collect()))


def test_sink_round_trip_spreads_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 2.0]), (2, [1e-7, 3.25])], "id long, features array<double>")
    path = str(tmp_path / "out")
    records.write_delimited(df, path, delimiter="|")
    schema = "id long, a double, b double"
    rows = spark.read.schema(schema).option("sep", "|").csv(path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 0.5, 2.0), (2, 1e-7, 3.25)]


def test_partition_hint(spark, text_file):
    path = text_file(["1,2", "3,4"])
    assert records.read_delimited(spark, path, records.numeric_schema(2), partitions=12).rdd.getNumPartitions() == 12


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(500)
    parts = [records.split_by_hash(df, "id", 3, i) for i in range(3)]
    ids = [r.id for part in parts for r in part.collect()]
    assert sorted(ids) == list(range(500))


def test_field_shaping(spark):
    df = spark.createDataFrame([("0,tcp,http,SF,4,5,normal.,17",)], "value string")
    fields = records.split_fields(df)
    row = shape.split_tail(fields, "fields", ["label", "row"]).first()
    assert (row.label, row.row) == ("normal.", "17")
    kept = fields.select(shape.remove_fields(F.col("fields"), 1, 3).alias("f")).first().f
    assert kept == ["0", "4", "5", "normal.", "17"]


def test_recode_leaves_unlisted_values(spark):
    df = spark.createDataFrame([("tcp",), ("icmp",), ("gre",)], "p string")
    codes = {name: i for i, name in enumerate(records.PROTOCOLS)}
    assert [r.c for r in df.select(shape.recode(F.col("p"), codes).alias("c")).collect()] == ["0", "2", "gre"]


def test_field_counts_keep_trailing_empties(spark):
    df = spark.createDataFrame([("a,b,c",), ("a,,",), ("",)], "value string")
    assert {(r.n_fields, r.n_lines) for r in shape.field_counts(df).collect()} == {(3, 2), (1, 1)}


def test_report_line_layout(spark):
    df = spark.createDataFrame([(0, "normal.", 972781)], "cluster int, label string, count long")
    assert df.select(shape.report_line().alias("l")).first().l == "0" + " " * 11 + "normal." + "  972781"


def test_first_per_group_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("g"), (999 - F.col("id")).alias("o")).repartition(6)
    rows = shape.first_per_group(df, "g", ["o"], 2).collect()
    expected = {g: sorted(999 - i for i in range(1000) if i % 3 == g)[:2] for g in range(3)}
    assert {g: sorted(r.o for r in rows if r.g == g) for g in range(3)} == expected


def test_malformed_lines_are_kept_with_file_line_and_reason(spark, tmp_path):
    lines = ["tcp,1.5,3", "udp,x,y", "", "tcp,1", "tcp,,", '"a,b",2,3', "tcp,1,2,3", "icmp,1.0,2.5"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.csv").write_text("tcp,2,4\n  \n")
    clean, kept = records.read_sorted_out(spark, str(tmp_path / "in"), T.StructType().add("p", "string").add("v", "double").add("_malformed", "integer"))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(
        [("tcp", 1.5, 3), ("tcp", None, None), ("a,b", 2.0, 3), ("tcp", 2.0, 4)], key=str
    )
    found = {(r.file.rsplit("/", 1)[1], r.line): (r.reason, r.column, r.value) for r in kept.collect()}
    assert found == {
        ("a.csv", 2): ("value", "v", "udp,x,y"),
        ("a.csv", 3): ("empty", None, ""),
        ("a.csv", 4): ("fields", None, "tcp,1"),
        ("a.csv", 7): ("fields", None, "tcp,1,2,3"),
        ("a.csv", 8): ("value", "_malformed", "icmp,1.0,2.5"),
        ("b.csv", 2): ("empty", None, "  "),
    }
