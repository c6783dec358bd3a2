"""Category dictionaries and one-hot feature rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, idx)``: sorted distinct values of every column, numbered from 0.

    One scan for all columns; the numbering window only sees distinct values and is
    partitioned by feature.
    """
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.trim(F.col(c)).alias("value")) for c in columns])
        ).alias("p")
    ).select("p.feature", "p.value")
    distinct = pairs.filter(F.col("value").isNotNull()).distinct()
    window = Window.partitionBy("feature").orderBy("value")
    return distinct.withColumn("idx", (F.row_number().over(window) - 1).cast("int"))


@dataclass(frozen=True)
class OneHot:
    """Fitted dictionaries: for every categorical column its sorted values."""

    values: dict[str, list[str]]

    def width(self) -> int:
        return sum(len(v) for v in self.values.values())

    def block(self, column: str) -> Column:
        known = F.array(*[F.lit(v) for v in self.values[column]])
        value = F.trim(F.col(column))
        return F.transform(known, lambda v: F.when(v == value, 1.0).otherwise(0.0))

    def is_known(self, column: str) -> Column:
        return F.coalesce(F.trim(F.col(column)).isin(self.values[column]), F.lit(False))


def fit_one_hot(df: DataFrame, columns: Sequence[str], max_values: int = 10_000) -> OneHot:
    """Collect the dictionaries; a column with more than ``max_values`` values raises,
    since a one-hot block of that width is a modelling error, not data to cut."""
    table = dictionary(df, columns)
    rows = table.limit(len(columns) * max_values + 1).collect()
    values: dict[str, list[str]] = {c: [] for c in columns}
    for row in sorted(rows, key=lambda r: (r.feature, r.idx)):
        values[row.feature].append(row.value)
    for column, found in values.items():
        if len(found) > max_values:
            raise ValueError(f"{column} has more than {max_values} distinct values")
    return OneHot(values)


def encode(
    df: DataFrame,
    numeric: Sequence[str],
    model: OneHot | None = None,
    unseen: str = "error",
    output: str = "features",
) -> DataFrame:
    """Assemble ``[first numeric, one-hot blocks..., other numerics]``.

    ``unseen`` says what a value outside the dictionary does: ``error`` raises, ``keep``
    gives an all-zero block, ``skip`` leaves the row out.
    """
    numbers = [F.col(c).cast("double") for c in numeric]
    blocks = [] if model is None else list(model.values)
    if model is not None and unseen == "skip":
        for column in blocks:
            df = df.filter(model.is_known(column))
    if not blocks:
        return df.withColumn(output, F.array(*numbers))
    parts = [F.array(*numbers[:1])]
    for column in blocks:
        block = model.block(column)
        if unseen == "error":
            message = F.concat(F.lit(f"value of {column} not in dictionary: "), F.coalesce(F.col(column), F.lit("null")))
            block = F.when(model.is_known(column), block).otherwise(F.raise_error(message).cast("array<double>"))
        elif unseen not in ("keep", "skip"):
            raise ValueError(f"unseen must be error, keep or skip, not {unseen}")
        parts.append(block)
    if len(numbers) > 1:
        parts.append(F.array(*numbers[1:]))
    return df.withColumn(output, F.concat(*parts))
