"""Row shaping: split, cast, recode, classify, count fields, number lines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMAL = "normal."


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_position(df: DataFrame, position: int) -> DataFrame:
    """Remove the column at a 0-based position."""
    return df.select([F.col(f"`{c}`") for i, c in enumerate(df.columns) if i != position])


def split_tail(df: DataFrame, fields: str, names: Sequence[str]) -> DataFrame:
    """Move the last ``len(names)`` elements of an array column into own columns."""
    count = len(names)
    tail = [F.element_at(F.col(fields), i - count).alias(name) for i, name in enumerate(names)]
    rest = F.slice(F.col(fields), F.lit(1), F.size(fields) - count).alias(fields)
    return df.select(*[c for c in df.columns if c != fields], rest, *tail)


def remove_fields(fields: Column, start: int, count: int) -> Column:
    """Array without ``count`` elements from 0-based ``start``."""
    size = F.size(fields)
    return F.concat(
        F.slice(fields, F.lit(1), F.lit(start)),
        F.slice(fields, F.lit(start + count + 1), F.greatest(size - start - count, F.lit(0))),
    )


def to_doubles(fields: Column, strict: bool = True) -> Column:
    """Cast text fields to doubles; a non-number raises, or is null when lenient."""
    if strict:
        return F.transform(fields, lambda x: F.trim(x).cast("double"))
    return F.transform(fields, lambda x: F.trim(x).try_cast("double"))


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns})


def attack_flag(label: Column, normal: str = NORMAL) -> Column:
    """1.0 for every label but the normal one."""
    return F.when(label != normal, 1.0).otherwise(0.0)


def normal_flag(label: Column, normal: str = NORMAL) -> Column:
    """1.0 for the normal label, 0.0 for every other."""
    return F.when(label == normal, 1.0).otherwise(0.0)


def class_name(label: Column, normal: str = NORMAL) -> Column:
    return F.when(label == normal, "normal").otherwise("attack")


def recode(column: Column, mapping: Mapping[str, object]) -> Column:
    """Replace listed values, leave any other unchanged."""
    pairs = [F.lit(x) for key, value in mapping.items() for x in (str(key), str(value))]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)


def field_counts(lines: DataFrame, column: str = "value", delimiter: str = ",") -> DataFrame:
    """How many lines have how many fields."""
    size = F.size(F.split(F.col(column), _literal(delimiter), -1)).alias("n_fields")
    return lines.select(size).groupBy("n_fields").agg(F.count("*").alias("n_lines"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def count_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == value).agg(F.count("*").alias("n"))


def first_matches(df: DataFrame, condition: Column, order: Sequence[str], limit: int = 10) -> DataFrame:
    """The first rows, in key order, that satisfy a condition."""
    return df.filter(condition).orderBy(*order).limit(limit)


def delimited(columns: Sequence[str | Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def report_line(cluster: str = "cluster", label: str = "label", count: str = "count") -> Column:
    """Aligned text: cluster (1), label (18), count (8)."""
    return F.format_string(
        "%1s%18s%8s", F.col(cluster).cast("string"), F.col(label).cast("string"), F.col(count).cast("string")
    )


def first_per_group(df: DataFrame, group: str, order: Sequence[str], limit: int) -> DataFrame:
    """First rows of every group in key order, for a small number of groups.

    Every task keeps only its own first rows per group while it reads, so neither a sort
    of the data nor a hot group costs anything; the window sees those few rows.
    """
    keys = [(group, "ascending"), *[(c, "ascending") for c in order]]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
            groups = rows[group].to_numpy()
            starts = np.searchsorted(groups, groups)
            kept = rows.filter(pa.array(np.arange(len(groups)) - starts < limit))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    few = df.mapInArrow(first, df.schema)
    window = Window.partitionBy(group).orderBy(*order)
    return few.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= limit).drop("_n")


def _literal(delimiter: str) -> str:
    """The delimiter as a pattern that matches it literally."""
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in delimiter)
