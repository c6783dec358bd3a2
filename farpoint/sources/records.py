"""Delimited text in and out: schemas, scans, stable row numbers, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farpoint.session import materialize

# The network connection record has 42 fields, numbered 0 to 41.
CATEGORICAL = ("protocol", "service", "state")
NUMERIC = ("f0", *[f"f{i}" for i in range(4, 41)])

# Category codes of the connection record (position in the list = code).
PROTOCOLS = ("tcp", "udp", "icmp")
STATES = ("OTH", "REJ", "RSTO", "RSTOS0", "RSTR", "S0", "S1", "S2", "S3", "SF", "SH")
SERVICES = (
    "aol", "auth", "bgp", "courier", "csnet_ns", "ctf", "daytime", "discard", "domain", "domain_u",
    "echo", "eco_i", "ecr_i", "efs", "exec", "finger", "ftp", "ftp_data", "gopher", "harvest",
    "hostnames", "http", "http_2784", "http_443", "http_8001", "imap4", "IRC", "iso_tsap", "klogin", "kshell",
    "ldap", "link", "login", "mtp", "name", "netbios_dgm", "netbios_ns", "netbios_ssn", "netstat", "nnsp",
    "nntp", "ntp_u", "other", "pm_dump", "pop_2", "pop_3", "printer", "private", "red_i", "remote_job",
    "rje", "shell", "smtp", "sql_net", "ssh", "sunrpc", "supdup", "systat", "telnet", "tftp_u",
    "time", "tim_i", "urh_i", "urp_i", "uucp", "uucp_path", "vmnet", "whois", "X11", "Z39_50",
)


def connection_schema() -> T.StructType:
    """Field 0 numeric, 1-3 categorical, 4-40 numeric, 41 the label."""
    fields = [T.StructField("f0", T.DoubleType())]
    fields += [T.StructField(c, T.StringType()) for c in CATEGORICAL]
    fields += [T.StructField(f"f{i}", T.DoubleType()) for i in range(4, 41)]
    return T.StructType([*fields, T.StructField("label", T.StringType())])


def numeric_schema(width: int, prefix: str = "f", tail: Sequence[T.StructField] = ()) -> T.StructType:
    return T.StructType([*[T.StructField(f"{prefix}{i}", T.DoubleType()) for i in range(width)], *tail])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    delimiter: str = ",",
    strict: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Header-less delimited files with a declared schema.

    ``strict`` fails on a value that does not parse; otherwise it becomes null.
    ``partitions`` is a hint: the scan is spread over at least that many tasks.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    df = spark.read.schema(schema).option("mode", mode).option("sep", delimiter).csv(path)
    return df.repartition(partitions) if partitions else df


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def split_fields(lines: DataFrame, delimiter: str = ",", output: str = "fields") -> DataFrame:
    """Line text to an array of fields; quotes have no meaning."""
    return lines.select(F.split(F.col("value"), "\\" + delimiter if not delimiter.isalnum() else delimiter, -1).alias(output))


def read_numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line_no, value)`` with 1-based numbers in path, then file order."""
    return _numbered(spark, path).select("line_no", "value")


def read_sorted_out(
    spark: SparkSession, path: str | list[str], schema: T.StructType, delimiter: str = ","
) -> tuple[DataFrame, DataFrame]:
    """The lines that fit the schema, as typed rows, and those that do not; together all lines.

    A quarantined line keeps its ``file``, ``line`` (from 1, in that file) and ``value``; its
    ``reason`` is "empty" for blank lines, "fields" for too many or too few fields, or "value", with
    the first ``column`` that does not parse.  The lines are numbered once, in a stored table.
    Empty fields are null, as in other scans.
    """
    bad = "_malformed"
    while bad.lower() in {name.lower() for name in schema.names}:
        bad += "_"
    options = {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}

    def parsed(types: T.StructType) -> Column:
        return F.from_csv("value", T.StructType([*types, T.StructField(bad, T.StringType())]).toDDL(), options)

    lines = materialize(_numbered(spark, path).withColumn("row", parsed(schema)), "sorted-out")
    blank, malformed = F.trim("value") == "", F.col(f"row.{bad}").isNotNull()
    clean = lines.filter(~blank & ~malformed).select(*[F.col(f"row.`{name}`") for name in schema.names])
    texts = T.StructType([T.StructField(name, T.StringType()) for name in schema.names])
    wrong = F.coalesce(
        *[F.when(F.col(f"text.`{name}`").isNotNull() & F.col(f"row.`{name}`").isNull(), name) for name in schema.names]
    )
    reason = F.when(blank, "empty").when(F.col(f"text.{bad}").isNotNull(), "fields").otherwise("value")
    kept = lines.filter(blank | malformed).withColumn("text", parsed(texts)).withColumn("reason", reason)
    column = F.when(F.col("reason") == "value", wrong)
    return clean, kept.select("file", "line", "reason", column.alias("column"), "value")


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line_no, file, line, value)``: numbers over all files, and in each.

    A scan task reads a byte range of one file front to back, so a row's number is the
    number of rows in all earlier ranges plus its position in its own.  Two scans; only
    the table of ranges is ordered, the rows are neither shuffled nor sorted.  Should
    the files change between the scans, the numbering raises.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    ranges = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    ranges = materialize(ranges, "line-ranges")
    per_file = ranges.groupBy("file").agg(F.sum("n").alias("file_n"))
    file_offsets = per_file.withColumn("file_offset", _running_total("file_n", Window.orderBy("file")))
    in_file = Window.partitionBy("file").orderBy("start")
    offsets = (
        ranges.withColumn("range_offset", _running_total("n", in_file))
        .join(file_offsets.drop("file_n"), "file")
        .select("file", "start", "n", "first_seq", "range_offset", "file_offset")
    )
    position = F.col("seq") - F.col("first_seq")
    number = F.when((position >= 0) & (position < F.col("n")), F.col("range_offset") + position + 1).otherwise(
        F.raise_error(F.lit("input changed while its lines were numbered")).cast("long")
    )
    joined = lines.join(offsets, ["file", "start"], "left").withColumn("line", number)
    return joined.select((F.col("line") + F.col("file_offset")).alias("line_no"), "file", "line", "value")


def _running_total(column: str, window) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def with_row_id(df: DataFrame, output: str = "id") -> DataFrame:
    """Give key-less rows a stable unique id and store them once.

    The id is unique and increasing, not consecutive; storing the rows fixes it for
    every later read, whatever the plan.
    """
    return materialize(df.withColumn(output, F.monotonically_increasing_id()), "ingested")


def split_by_hash(df: DataFrame, key: str, parts: int, index: int) -> DataFrame:
    """The ``index``-th of ``parts`` disjoint subsets, fixed by the row's key."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == index)


def split_by_modulus(df: DataFrame, key: str, parts: int, index: int) -> DataFrame:
    """As :func:`split_by_hash` for an integer key."""
    return df.filter(F.pmod(F.col(key), F.lit(parts)) == index)


def with_split(df: DataFrame, key: str, shares: Mapping[str, int], output: str = "part") -> DataFrame:
    """Name every row's part from its integer key modulo the sum of the shares, in one scan."""
    position, name, upper = F.pmod(F.col(key), F.lit(sum(shares.values()))), None, 0
    for part, share in shares.items():
        upper += share
        name = F.when(position < upper, part) if name is None else name.when(position < upper, part)
    return df.withColumn(output, name)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """Directory of header-less text parts, one per task; array columns are spread
    over the line."""
    columns = []
    for field in df.schema.fields:
        text = F.col(field.name).cast("string")
        if isinstance(field.dataType, T.ArrayType):
            text = F.concat_ws(delimiter, F.col(field.name).cast("array<string>"))
        columns.append(F.coalesce(text, F.lit("")))
    df.select(F.concat_ws(delimiter, *columns).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
