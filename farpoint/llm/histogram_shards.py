"""Sharding by histogram sort.

Rows have a place in one order: by a hash of the text, then by id.  Equal texts are
neighbours in it.  The boundaries between shards are found by probing: each round counts the
exact bytes of all rows below the candidate boundaries of every splitter, across partitions,
and narrows each splitter to the candidate interval that holds its target, until the interval
weighs no more than the tolerance.  A splitter caught inside one hash value, that is in one
group of equal texts, is refined further over the ids.  Then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import fresh_name, text_or_empty
from farpoint.session import materialize

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Candidate boundaries that a round tries between the ends of a splitter's interval.
PROBES = 1024
#: Bytes that a task of the exchange is meant to get.
TASK_BYTES = 32 << 20


@dataclass(frozen=True)
class _Interval:
    """Places from ``low`` to ``high``, both included, of one key column; ``below`` bytes precede it."""

    low: int
    high: int
    below: int
    weight: int
    fixed: int | None = None  # the hash value whose ids are being split

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // PROBES))


def size_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def _round(rows: DataFrame, level: str, intervals: list[_Interval]) -> dict[int, list[tuple[int, int]]]:
    """Exact bytes in each candidate interval: ``{interval: [(candidate, bytes)]}``, one pass for all."""
    which, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, at in enumerate(intervals):
        inside = F.col(level).between(at.low, at.high)
        if at.fixed is not None:
            inside &= F.col("place") == at.fixed
        # the difference may pass the range of a long: halves keep it exact
        offset = F.col(level).cast("decimal(20,0)") - F.lit(at.low).cast("decimal(20,0)")
        which = F.when(inside, i).otherwise(which)
        cell = F.when(inside, F.floor(offset / F.lit(at.step).cast("decimal(20,0)")).cast("long")).otherwise(cell)
    counted = (
        rows.select(which.alias("i"), cell.alias("c"), "size")
        .where("i is not null")
        .groupBy("i", "c")
        .agg(F.sum("size").alias("bytes"))
    )
    found: dict[int, list[tuple[int, int]]] = {}
    for i, c, held in counted.collect():  # at most PROBES rows a splitter
        found.setdefault(i, []).append((c, held))
    return {i: sorted(v) for i, v in found.items()}


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.005) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries ``(place, id)``: a row below a boundary lies in an earlier shard.

    ``rows`` has ``place``, ``id`` (longs without nulls) and ``size``.  Every boundary has its
    share of the bytes below it, give or take ``tolerance`` of a shard or half the heaviest row
    set that cannot be told apart (equal text and id).
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * i / shards for i in range(1, shards)]
    slack = tolerance * total / shards
    at = {i: _Interval(_LOW, _HIGH, 0, total) for i in range(shards - 1)}
    done: dict[int, tuple[int, int]] = {}
    while open_ := {i: v for i, v in at.items() if i not in done}:
        for level in ("place", "id"):
            wanted = sorted(
                {v for v in open_.values() if (v.fixed is None) == (level == "place")},
                key=lambda v: (v.fixed or 0, v.low),
            )
            counts = _round(rows, level, wanted) if wanted else {}
            for i, interval in open_.items():
                if interval in wanted:
                    at[i], end = _narrow(interval, counts.get(wanted.index(interval), []), targets[i], slack)
                    if end:
                        done[i] = end
    return [done[i] for i in range(shards - 1)]


def _narrow(
    interval: _Interval, counts: list[tuple[int, int]], target: float, slack: float
) -> tuple[_Interval, tuple[int, int] | None]:
    """The candidate interval that holds the target, or the boundary if one is near enough."""
    below = interval.below
    for cell, held in counts:
        if below + held >= target or (cell, held) == counts[-1]:
            break
        below += held
    else:
        return interval, _boundary(interval, interval.low)
    low = interval.low + cell * interval.step
    high = min(interval.high, low + interval.step - 1)
    before, after = target - below, below + held - target
    if min(before, after) <= slack:
        return interval, _boundary(interval, low if before <= after else high + 1)
    if low < high:
        return _Interval(low, high, below, held, interval.fixed), None
    if interval.fixed is None:  # one group of equal texts: split it by id
        return _Interval(_LOW, _HIGH, below, held, low), None
    return interval, _boundary(interval, low if before <= after else high + 1)


def _boundary(interval: _Interval, at: int) -> tuple[int, int]:
    """``(place, id)`` of the first row above; a place past the last one is beyond every id."""
    if interval.fixed is not None:
        return (interval.fixed, at) if at <= _HIGH else (interval.fixed + 1, _LOW)
    return at, _LOW


def with_shards(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = 0.005,
    out: tuple[str, str] = ("shard", "slot"),
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1, near equal in bytes) and a gapless ``slot`` in it.

    A row weighs its text's UTF-8 bytes plus one; null and empty texts weigh one.  Equal texts
    lie together; a boundary cuts such a group only where no end of the group is within the
    tolerance.  A null id counts as the least long.  Rows of equal id and text are not parted.
    The slots follow the buckets of the exchange, then hash, id and all other columns; rows
    equal in all columns may swap slots.  An empty table gives an empty table.  Clashing names
    are kept apart: columns of ``docs`` named like ``out`` are replaced.
    """
    docs = docs.drop(*out)
    place, tie, size, bucket, first = (fresh_name(docs, c) for c in ("row_place", "row_tie", "row_size", "row_bucket", "row_first"))
    marked = docs.withColumns({
        place: F.xxhash64(text_or_empty(text)),
        tie: F.coalesce(F.col(key).cast("long"), F.lit(_LOW)),
        size: size_bytes(text),
    })
    small = materialize(marked.select(F.col(place).alias("place"), F.col(tie).alias("id"), F.col(size).alias("size")), "places")
    ends = splitters(small, shards, tolerance)

    def shard_of(place: str, tie: str) -> Column:
        shard = F.lit(0)
        for p, t in ends:
            beyond = F.lit(False) if p > _HIGH else (F.col(place) > p) | ((F.col(place) == p) & (F.col(tie) >= t))
            shard += beyond.cast("int")
        return shard

    total = small.agg(F.sum("size")).first()[0] or 0
    buckets = max(16, -(-total // (shards * TASK_BYTES)))

    def bucket_of(place: str, tie: str) -> Column:
        return F.pmod(F.xxhash64(F.col(place), F.col(tie)), F.lit(buckets))

    counts = small.groupBy(shard_of("place", "id").alias(out[0]), bucket_of("place", "id").alias(bucket)).count()
    order = Window.partitionBy(out[0]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(out[0], bucket, F.coalesce(F.sum("count").over(order), F.lit(0)).alias(first))
    dealt = marked.withColumns({out[0]: shard_of(place, tie), bucket: bucket_of(place, tie)})
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in (key, text) and not kind.startswith(("map", "variant"))]
    inside = Window.partitionBy(out[0], bucket).orderBy(place, tie, F.xxhash64(*rest) if rest else F.lit(0))
    ranked = dealt.withColumn(out[1], F.row_number().over(inside))
    return ranked.join(starts, [out[0], bucket]).select(
        *[ranked[f"`{c}`"] for c in docs.columns],
        ranked[out[0]],
        (F.col(first) + F.col(out[1]) - 1).cast("long").alias(out[1]),
    )
