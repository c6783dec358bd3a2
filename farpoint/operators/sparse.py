"""One-hot rows as positions and values, for dictionaries too wide for dense arrays.

A row is ``struct<size int, indices array<int>, values array<double>>`` with the layout of
:func:`encode.encode`: the first number, a block for every categorical column, the other numbers.
The dictionary stays a table.  Distances and projections read the centres' entries, which go along
with the tasks while they are small; beyond that rows' entries are joined with them by position.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farpoint.functions import vectors
from farpoint.session import materialize

SPARSE = T.StructType(
    [
        T.StructField("size", T.IntegerType()),
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", vectors.DOUBLES),
    ]
)
#: A dictionary's values go along with the tasks up to so many bytes of text.
_DICTIONARY_BYTES = 16 * 1024 * 1024
_MODEL_BYTES = 64 * 1024 * 1024
_BUFFER_VALUES = 2_000_000


def encode_sparse(
    df: DataFrame, numeric: Sequence[str], dictionary: DataFrame, unseen: str = "error", output: str = "features"
) -> DataFrame:
    """Add the sparse row; ``dictionary (feature, value, idx)`` is a stored table of :func:`encode.dictionary`.

    ``unseen`` is as in :func:`encode.encode`: ``error``, ``keep`` (no entry) or ``skip`` (no row).
    A column's blocks come in the order of their names.  A missing number is a missing value.
    """
    if unseen not in ("error", "keep", "skip"):
        raise ValueError(f"unseen must be error, keep or skip, not {unseen}")
    columns = dictionary.groupBy("feature").agg(
        (F.max("idx") + 1).alias("width"), F.sum(F.octet_length("value") + 8).alias("bytes")
    )
    at, entries = 1, [F.array(_entry(F.lit(0), numeric[0]))]
    kept = df.columns
    for found in columns.orderBy("feature").collect():  # one row a column
        value, place = f"__value_{found.feature}", f"__place_{found.feature}"
        known = dictionary.filter(F.col("feature") == found.feature).select(F.col("value").alias(value), F.col("idx").alias(place))
        known = F.broadcast(known) if found.bytes <= _DICTIONARY_BYTES else known
        df = df.join(known, F.trim(F.col(found.feature)) == F.col(value), "inner" if unseen == "skip" else "left")
        none = F.array().cast("array<struct<i:int,v:double>>")
        if unseen == "error":
            message = F.concat(F.lit(f"value of {found.feature} not in dictionary: "), F.coalesce(F.col(found.feature), F.lit("null")))
            none = F.raise_error(message).cast("array<struct<i:int,v:double>>")
        own = F.array(F.struct((F.col(place) + at).cast("int").alias("i"), F.lit(1.0).alias("v")))
        entries.append(F.when(F.col(place).isNull(), none).otherwise(own))
        at += found.width
    if len(numeric) > 1:
        entries.append(F.array(*[_entry(F.lit(at + i), c) for i, c in enumerate(numeric[1:])]))
    size = at + len(numeric) - 1
    row = F.concat(*entries)
    indices, values = F.transform(row, lambda e: e["i"]), F.transform(row, lambda e: e["v"])
    sparse = F.struct(F.lit(size).cast("int").alias("size"), indices.alias("indices"), values.alias("values"))
    return df.select(*[c for c in kept if c != output], sparse.alias(output))


def _entry(index: Column, number: str) -> Column:
    return F.struct(index.cast("int").alias("i"), F.col(number).cast("double").alias("v"))


def to_dense(row) -> np.ndarray:
    """One collected sparse row as an array."""
    out = np.zeros(row["size"])
    out[row["indices"]] = row["values"]
    return out


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two sparse rows (X1), by their common positions."""
    other = F.map_from_arrays(b["indices"], b["values"])
    mine = F.map_from_arrays(a["indices"], a["values"])
    here = F.aggregate(
        F.map_entries(mine), F.lit(0.0), lambda s, e: s + F.pow(e["value"] - F.coalesce(other[e["key"]], F.lit(0.0)), F.lit(2.0))
    )
    alone = F.filter(F.map_entries(other), lambda e: ~F.map_contains_key(mine, e["key"]))
    return F.aggregate(alone, here, lambda s, e: s + e["value"] * e["value"])


Centers = np.ndarray | Sequence


def _entries(centers: Centers) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many centres, and cluster, position and value of their nonzero entries."""
    if isinstance(centers, np.ndarray):
        cluster, index = np.nonzero(centers)
        return len(centers), cluster, index, centers[cluster, index].astype(float)
    cluster = np.repeat(np.arange(len(centers)), [len(c["indices"]) for c in centers])
    index = np.array([i for c in centers for i in c["indices"]], dtype=np.int64)
    return len(centers), cluster, index, np.array([v for c in centers for v in c["values"]], dtype=float)


def products(df: DataFrame, centers: Centers, output: str, features: str = "features", model_bytes: int = _MODEL_BYTES) -> DataFrame:
    """Add an array: the product of the row with every one of ``centers``, a matrix or collected sparse rows (P3).

    Of the centres only positions that are not 0 in all of them are kept.  Under ``model_bytes`` they
    go along with the tasks.  More of them become a table of entries, which the rows' entries are
    joined with by position; rows are numbered for that in a stored table.  The two ways differ by
    rounding alone.
    """
    k, cluster, index, value = _entries(centers)
    used = np.unique(index)
    if k * len(used) * 8 <= model_bytes:
        wide = np.zeros((len(used), k))
        wide[np.searchsorted(used, index), cluster] = value

        @F.arrow_udf(vectors.DOUBLES)
        def multiply(column: pa.Array) -> pa.Array:
            return vectors.to_lists(_multiply(column, used, wide))

        return df.withColumn(output, vectors.once(multiply, F.col(features)))
    number = "_row"
    while number in df.columns:
        number += "_"
    rows = materialize(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    given = pa.table({"c": cluster.astype(np.int32), "i": index.astype(np.int32), "m": value})
    pairs = F.arrays_zip(F.col(features)["indices"].alias("i"), F.col(features)["values"].alias("v"))
    entries = rows.select(number, F.explode(pairs).alias("e")).select(number, "e.i", "e.v").filter(F.col("v") != 0)
    sums = entries.join(df.sparkSession.createDataFrame(given), "i").groupBy(number, "c").agg(F.sum(F.col("v") * F.col("m")).alias("p"))
    lists = sums.groupBy(number).agg(F.map_from_entries(F.collect_list(F.struct("c", "p"))).alias("_sums"))
    each = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.col("_sums")[c], F.lit(0.0)))
    found = F.when(F.col("_sums").isNull(), F.array_repeat(F.lit(0.0), k)).otherwise(each)
    return rows.join(lists, number, "left").withColumn(output, found).drop("_sums", number)


def center_distances(
    df: DataFrame, centers: Centers, output: str = "dists", features: str = "features", model_bytes: int = _MODEL_BYTES
) -> DataFrame:
    """Add the squared distances to all centres (X5), not below 0: ``|x|^2 - 2 x.c + |c|^2``."""
    found = products(df, centers, output, features, model_bytes)
    k, cluster, _, value = _entries(centers)
    norms = F.array(*[F.lit(float(v)) for v in np.bincount(cluster, weights=value * value, minlength=k)])
    own = F.aggregate(F.col(features)["values"], F.lit(0.0), lambda s, v: s + v * v)
    return found.withColumn(output, F.zip_with(output, norms, lambda p, c: F.greatest(own - 2 * p + c, F.lit(0.0))))


def assign(df: DataFrame, centers: Centers, features: str = "features", model_bytes: int = _MODEL_BYTES) -> DataFrame:
    """Add ``cluster`` and ``sq_distance`` of the nearest centre, the lowest of equals (K5)."""
    at = "_dists"
    found = center_distances(df, centers, at, features, model_bytes)
    least = F.array_min(at)
    return found.withColumns({"cluster": (F.array_position(at, least) - 1).cast("int"), "sq_distance": least}).drop(at)


def _multiply(column: pa.Array, used: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Rows of ``column`` times ``wide``, whose lines stand at the positions ``used``; some rows at a
    time, so that the gathered lines stay few."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    indices, values = pc.struct_field(column, "indices"), pc.struct_field(column, "values")
    lengths = pc.list_value_length(indices).to_numpy(zero_copy_only=False)
    i = indices.flatten().to_numpy(zero_copy_only=False)
    v = np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=float)
    row = np.repeat(np.arange(len(column)), lengths)
    out = np.zeros((len(column), wide.shape[1]))
    at = np.searchsorted(used, i)
    met = np.flatnonzero((at < len(used)) & (used[np.minimum(at, max(len(used) - 1, 0))] == i)) if len(used) else np.empty(0, int)
    step = max(1, _BUFFER_VALUES // max(1, wide.shape[1]))
    for start in range(0, len(met), step):
        part = met[start : start + step]
        np.add.at(out, row[part], wide[at[part]] * v[part, None])
    return out
