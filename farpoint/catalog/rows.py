"""Scans, sinks and row shaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from farpoint.catalog.base import KEYS, NUMBERS, SQL_ID, SQL_LABEL, SQL_LINES, embeddings, lines, query, r, rounded, table
from farpoint.operators import encode, evaluate, scale, shape
from farpoint.session import materialize, scratch_path
from farpoint.sources import records

_TEXT = ("l_returnflag", "l_linestatus")
_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in KEYS],
        *[T.StructField(c, T.DoubleType()) for c in NUMBERS],
        *[T.StructField(c, T.StringType()) for c in _TEXT],
    ]
)
_ROWS = f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, {', '.join(NUMBERS)}, {', '.join(_TEXT)} FROM lineitem"


def stored_text(spark, sf_dir, delimiter=","):
    path = scratch_path(spark, "lineitem-text")
    records.write_delimited(lines(spark, sf_dir).select(*KEYS, *NUMBERS, *_TEXT), path, delimiter)
    return path


def text_lines(spark, sf_dir):
    """One line of text per lineitem row: numbers, three categories and a label last,
    then the key as row index."""
    df = lines(spark, sf_dir)
    value = F.concat_ws(
        ",",
        F.col("l_quantity").cast("string"),
        "l_returnflag",
        "l_linestatus",
        F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(3)).cast("string")),
        *[F.col(c).cast("string") for c in NUMBERS[1:]],
        "label",
        "id",
    )
    return df.select("id", value.alias("value"))


def fields(spark, sf_dir, keep_index=False):
    """Lines split into ``id`` and an array of fields that ends in the label."""
    split = text_lines(spark, sf_dir).select("id", F.split("value", ",").alias("fields"))
    if keep_index:
        return split
    return split.withColumn("fields", F.slice("fields", F.lit(1), F.size("fields") - 1))


# --- scans and sinks ---------------------------------------------------------


@query("a1_csv_scan", _ROWS)
def csv_scan(spark, sf_dir):
    return records.read_delimited(spark, stored_text(spark, sf_dir), _SCHEMA)


_FATE = """CASE WHEN l_orderkey % 7 = 0 THEN 'fields' WHEN l_orderkey % 11 = 0 THEN 'value' ELSE 'clean' END"""


@query(
    "a1_quarantined_lines",
    f"""SELECT {_FATE} AS reason, CASE WHEN {_FATE} = 'value' THEN 'l_quantity' END AS "column", count(*) AS n,
      {r("sum(CASE WHEN " + _FATE + " = 'clean' THEN l_quantity END)")} AS quantity FROM lineitem GROUP BY ALL""",
)
def quarantined_lines(spark, sf_dir):
    """Lines of lineitem, some cut short and some with a word for a number, sorted out by the scan."""
    cells = [F.col(c).cast("string") for c in (*KEYS, *NUMBERS, *_TEXT)]
    wordy = [F.lit("many") if c == "l_quantity" else cell for c, cell in zip((*KEYS, *NUMBERS, *_TEXT), cells)]
    value = F.when(F.col("l_orderkey") % 7 == 0, F.concat_ws(",", *cells[:-1]))
    value = value.when(F.col("l_orderkey") % 11 == 0, F.concat_ws(",", *wordy)).otherwise(F.concat_ws(",", *cells))
    path = scratch_path(spark, "lineitem-malformed")
    lines(spark, sf_dir).select(value.alias("value")).write.text(path)
    clean, kept = records.read_sorted_out(spark, path, _SCHEMA)
    counted = clean.agg(F.count("*").alias("n"), rounded(F.sum("l_quantity")).alias("quantity"))
    counted = counted.select(F.lit("clean").alias("reason"), F.lit(None).cast("string").alias("column"), "n", "quantity")
    return counted.unionByName(kept.groupBy("reason", "column").agg(F.count("*").alias("n")), allowMissingColumns=True)


@query(
    "a2_scan_with_partitions",
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag",
)
def scan_with_partitions(spark, sf_dir):
    df = records.read_delimited(spark, stored_text(spark, sf_dir), _SCHEMA, partitions=16)
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "a3_dictionary_and_normal_rows",
    f"""WITH {SQL_LINES}, dict AS (
      SELECT 'l_linestatus' AS feature, l_linestatus AS value FROM lines
      UNION SELECT 'l_returnflag', l_returnflag FROM lines),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS idx FROM dict),
    normal AS (SELECT * FROM lines WHERE label = 'normal.')
    SELECT feature, value, idx::INTEGER AS idx,
      (SELECT count(*) FROM normal n
       WHERE CASE feature WHEN 'l_linestatus' THEN n.l_linestatus ELSE n.l_returnflag END = value) AS normal_rows
    FROM numbered""",
)
def dictionary_and_normal_rows(spark, sf_dir):
    """Dictionaries from all rows, training rows from the normal ones only."""
    everything = lines(spark, sf_dir)
    normal = everything.filter(F.col("label") == shape.NORMAL)
    words = encode.dictionary(everything, _TEXT)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _TEXT]))
    found = normal.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias("normal_rows"))
    return words.join(found, ["feature", "value"], "left").fillna(0, ["normal_rows"])


@query(
    "a4_train_test_split",
    f"""WITH {SQL_LINES} SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9
      THEN 'validation' ELSE 'test' END AS part, label, count(*) AS n FROM lines GROUP BY ALL""",
)
def train_test_split(spark, sf_dir):
    parts = records.with_split(lines(spark, sf_dir), "l_orderkey", {"train": 7, "validation": 2, "test": 1})
    return parts.groupBy("part", "label").agg(F.count("*").alias("n"))


@query(
    "a5_numeric_csv",
    "SELECT l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3 FROM lineitem",
)
def numeric_csv(spark, sf_dir):
    path = scratch_path(spark, "numbers")
    records.write_delimited(lines(spark, sf_dir).select(*NUMBERS), path)
    return records.read_delimited(spark, path, records.numeric_schema(4))


@query("a6_headerless_frame", "SELECT vec_id AS id, i AS position, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)")
def headerless_frame(spark, sf_dir):
    path = scratch_path(spark, "embeddings-text")
    records.write_delimited(embeddings(spark, sf_dir).select("id", "features"), path)
    schema = T.StructType([T.StructField("id", T.LongType()), *records.numeric_schema(64).fields])
    df = records.read_delimited(spark, path, schema)
    spread = F.posexplode(F.array(*[f"f{i}" for i in range(64)])).alias("position", "v")
    return df.select("id", spread).withColumn("position", F.col("position").cast("long") + 1)


@query("a7_text_sink", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source")
def text_sink(spark, sf_dir):
    path = scratch_path(spark, "documents-text")
    records.write_delimited(table(spark, sf_dir, "documents").select("lang", "source", "n_chars"), path)
    parts = F.split("value", ",")
    df = records.read_lines(spark, path).select(
        parts[0].alias("lang"), parts[1].alias("source"), parts[2].cast("long").alias("n_chars")
    )
    return df.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a8_delimited_table_sink", _ROWS)
def delimited_table_sink(spark, sf_dir):
    return records.read_delimited(spark, stored_text(spark, sf_dir, "|"), _SCHEMA, delimiter="|")


@query(
    "a9_report_line",
    """SELECT l_suppkey % 5 AS cluster, l_returnflag AS label, count(*) AS n,
      lpad((l_suppkey % 5)::VARCHAR, 1, ' ') || lpad(l_returnflag, 18, ' ') || lpad(count(*)::VARCHAR, 8, ' ') AS line
    FROM lineitem GROUP BY 1, 2""",
)
def report_line(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.pmod("l_suppkey", F.lit(5)).alias("cluster"), F.col("l_returnflag").alias("label"))
    counts = df.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("line", shape.report_line(count="n"))


@query("a10_first_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query(
    "a11_reused_rows",
    """SELECT event_type, count(*) AS n, max(value) AS largest, (SELECT count(*) FROM events) AS total
    FROM events GROUP BY event_type""",
)
def reused_rows(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", "value").persist()
    try:
        total = df.count()
        counts = df.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest"))
        return materialize(counts.withColumn("total", F.lit(total).cast("long")), "counts")
    finally:
        df.unpersist()


# --- row shaping -------------------------------------------------------------

_SQL_NUMBERS = "l_quantity, l_extendedprice, l_discount, l_tax"


@query("b1_drop_categories", f"SELECT {SQL_ID} AS id, {_SQL_NUMBERS}, {SQL_LABEL} AS label FROM lineitem")
def drop_categories(spark, sf_dir):
    split = fields(spark, sf_dir)
    kept = split.withColumn("fields", shape.remove_fields(F.col("fields"), 1, 3))
    columns = [kept.fields[i].cast("double").alias(c) for i, c in enumerate(NUMBERS)]
    return kept.select("id", *columns, kept.fields[4].alias("label"))


@query("b2_split_label", f"SELECT {SQL_ID} AS id, {SQL_LABEL} AS label, 7::INTEGER AS n_fields FROM lineitem")
def split_label(spark, sf_dir):
    return shape.split_tail(fields(spark, sf_dir), "fields", ["label"]).select(
        "id", "label", F.size("fields").alias("n_fields")
    )


@query("b3_split_last_two", f"SELECT {SQL_ID} AS row_index, {SQL_LABEL} AS label, l_tax::VARCHAR AS last_field FROM lineitem")
def split_last_two(spark, sf_dir):
    split = shape.split_tail(fields(spark, sf_dir, keep_index=True).drop("id"), "fields", ["label", "row_index"])
    return split.select("row_index", "label", F.element_at("fields", -1).alias("last_field"))


@query("b4_cast_fields", f"SELECT {SQL_ID} AS id, l_quantity, {r('l_quantity + l_extendedprice + l_discount + l_tax', 4)} AS total FROM lineitem")
def cast_fields(spark, sf_dir):
    split = shape.split_tail(fields(spark, sf_dir), "fields", ["label"])
    numbers = shape.to_doubles(shape.remove_fields(F.col("fields"), 1, 3))
    total = F.aggregate("numbers", F.lit(0.0), lambda acc, v: acc + v)
    return split.withColumn("numbers", numbers).select(
        "id", F.element_at("numbers", 1).alias("l_quantity"), rounded(total, 4).alias("total")
    )


@query(
    "b4_cast_fields_lenient",
    """SELECT count(*) AS n, count(try_cast(field AS DOUBLE)) AS numbers
    FROM (SELECT unnest(string_split(text, ' ')) AS field FROM documents)""",
)
def cast_fields_lenient(spark, sf_dir):
    """Numbers among the words of every document; anything else becomes null."""
    words = table(spark, sf_dir, "documents").select(F.split("text", " ").alias("fields"))
    values = words.select(F.explode(shape.to_doubles(F.col("fields"), strict=False)).alias("v"))
    return values.agg(F.count("*").alias("n"), F.count("v").alias("numbers"))


@query("b5_trim_category", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def trim_category(spark, sf_dir):
    padded = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("flag"))
    return shape.trim_columns(padded, ["flag"]).groupBy("flag").agg(F.count("*").alias("n"))


@query("b6_binary_class", f"SELECT {SQL_ID} AS id, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS attack FROM lineitem")
def binary_class(spark, sf_dir):
    return lines(spark, sf_dir).select("id", shape.attack_flag(F.col("label")).alias("attack"))


@query("b7_string_class", f"SELECT {SQL_ID} AS id, CASE WHEN l_returnflag = 'R' THEN 'attack' ELSE 'normal' END AS class FROM lineitem")
def string_class(spark, sf_dir):
    return lines(spark, sf_dir).select("id", shape.class_name(F.col("label")).alias("class"))


@query("b8_filter_rows", f"SELECT {SQL_ID} AS id, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05 AND l_quantity >= 25")
def filter_rows(spark, sf_dir):
    wanted = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05) & (F.col("l_quantity") >= 25)
    return lines(spark, sf_dir).filter(wanted).select("id", "l_quantity")


@query("b9_keep_values", "SELECT l_quantity, l_tax FROM lineitem")
def keep_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax")


@query("b10_remove_column", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def remove_column(spark, sf_dir):
    df = table(spark, sf_dir, "orders").drop("o_orderdate")
    return shape.drop_position(df, df.columns.index("o_custkey"))


@query(
    "b11_recode_column",
    """SELECT CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE l_returnflag END AS code, count(*) AS n
    FROM lineitem GROUP BY 1""",
)
def recode_column(spark, sf_dir):
    code = shape.recode(F.col("l_returnflag"), {"A": 0, "N": 1}).alias("code")
    return table(spark, sf_dir, "lineitem").select(code).groupBy("code").agg(F.count("*").alias("n"))


@query(
    "b12_fields_per_line",
    """SELECT len(string_split(line, ','))::INTEGER AS n_fields, count(*) AS n_lines
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""",
)
def fields_per_line(spark, sf_dir):
    """Field counts over every line of every document."""
    text = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return shape.field_counts(text)


@query("b13_distinct_sorted", "SELECT DISTINCT p_type FROM part ORDER BY p_type")
def distinct_sorted(spark, sf_dir):
    return shape.distinct_sorted(table(spark, sf_dir, "part"), "p_type")


@query("b14_count_equal", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def count_equal(spark, sf_dir):
    return shape.count_equal(table(spark, sf_dir, "events"), "event_type", "error")


@query(
    "b15_first_matching_lines",
    """SELECT line_no, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line_no FROM orders)
    WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY line_no LIMIT 10""",
)
def first_matching_lines(spark, sf_dir):
    """Numbers of the first lines whose fields have given values, in file order."""
    path = scratch_path(spark, "orders-text")
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderkey")
    records.write_delimited(ordered, path)
    numbered = records.read_numbered_lines(spark, path).withColumn("fields", F.split("value", ","))
    condition = (F.col("fields")[2] == "1-URGENT") & (F.col("fields")[1] == "F")
    found = shape.first_matches(numbered, condition, ["line_no"])
    return found.select("line_no", F.col("fields")[0].cast("long").alias("o_orderkey"))


@query("b16_concatenate", f"SELECT concat_ws(',', l_linestatus, l_quantity, l_discount, l_tax, {SQL_ID}) AS line FROM lineitem")
def concatenate(spark, sf_dir):
    line = shape.delimited(["l_linestatus", "l_quantity", "l_discount", "l_tax", "id"])
    return lines(spark, sf_dir).select(line.alias("line"))


@query(
    "b17_record_beside_vector",
    f"""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem)
    SELECT {SQL_ID} AS id, l_returnflag, l_linestatus, l_quantity AS original, {r("(l_quantity - m) / sd")} AS scaled
    FROM lineitem, s""",
)
def record_beside_vector(spark, sf_dir):
    df = lines(spark, sf_dir)
    scaled = scale.fit_columns(df, ["l_quantity"]).transform(df, "_z")
    return scaled.select("id", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("original"), rounded("l_quantity_z").alias("scaled"))


@query(
    "b18_class_column",
    f"SELECT {SQL_ID} AS id, 1.0::DOUBLE AS one, CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS normal FROM lineitem",
)
def class_column(spark, sf_dir):
    return lines(spark, sf_dir).select("id", F.lit(1.0).alias("one"), shape.normal_flag(F.col("label")).alias("normal"))


@query("e6_counts_per_label", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, label")
def counts_per_label(spark, sf_dir):
    return evaluate.counts_per_label(table(spark, sf_dir, "events"), "event_type").withColumnRenamed("event_type", "label")
