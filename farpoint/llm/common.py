"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.session import materialize

#: What counts as a word, and as its complement, in every operator: bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_list(text: Column) -> Column:
    """The words of a text in order, without empty ones (native)."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def small_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """``df``; Arrow batches made from now on hold few rows, as whole texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def wide_hash(*columns: Column | str) -> Column:
    """128 bits that tell apart what differs in any column, nulls too: 64 would meet by chance among 10 ** 10 rows."""
    # a null leaves Spark's hash as it was, so where the nulls are is hashed as well
    nulls = [(F.col(c) if isinstance(c, str) else c).isNull() for c in columns]
    return F.struct(F.xxhash64(*columns, *nulls).alias("h"), F.xxhash64(F.lit(1), *columns, *nulls).alias("g"))


def row_key(df: DataFrame) -> Column:
    """A hash over all columns, equal for equal rows."""
    columns = [F.array_sort(F.map_entries(f"`{c}`")) if kind.startswith("map<") else F.col(f"`{c}`") for c, kind in df.dtypes]
    return wide_hash(*columns)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)`` of every node in ``edges (a, b)``; the label is the least node reachable.

    Large-star and small-star steps by turns until no edge changes.  Each round is written to
    the shared folder, so the plan stays short and a lost executor costs one round.  A node of
    very many links spreads over tasks: its least neighbour is combined before the shuffle, and
    the join that follows is one that adaptive execution can split.  Nulls and loops are left
    out; an empty table gives an empty table.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "links")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
