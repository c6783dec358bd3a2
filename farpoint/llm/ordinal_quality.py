"""Quality by ordinal cumulative-link regression on graded ratings.

One set of weights over hashed text features gives a text a position on a line; ordered
thresholds cut the line into grades.  P(grade <= k) is the logistic function of the k-th
threshold less the position.  From these follow the expected grade and the probability of a
grade of at least ``KEEP_FROM``, by which texts are selected.

The weights are fitted on a bounded sample of rated rows (``SAMPLE_ROWS``).  Every step of the
descent is one Spark job over the sample's stored features, of which each task returns one sum.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice, repeat
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import small_batches, text_or_empty
from farpoint.session import materialize

#: Rated rows that the weights are fitted on, at most.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 15
#: Tasks of a step, at most: the sample is bounded, and each task returns a sum of ``BUCKETS`` numbers.
TASKS = 32
STEPS = 40
RATE = 0.25
RIDGE = 1e-4
GRADES = 3
#: Texts are kept whose probability of at least this grade reaches ``KEEP_PROBABILITY``.
KEEP_FROM = 1
KEEP_PROBABILITY = 0.5

_LOWER, _UPPER, _DIGIT = re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def _step(x: float, parts: int = 10) -> int:
    return min(parts, int(x * parts))


@lru_cache(1)
def _letter_kinds() -> np.ndarray:
    """1 for every code point that is a letter, 2 more for a capital."""
    return np.fromiter((c.isalpha() + 2 * c.isupper() for c in map(chr, range(0x110000))), np.uint8, 0x110000)


def _group(mark: str, counts: dict[str, int], weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one kind of feature; the values have the length ``weight``."""
    start = zlib.crc32(mark.encode())
    places = np.fromiter(map(zlib.crc32, map(str.encode, counts), repeat(start)), np.int64, len(counts))
    logs = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    return places % BUCKETS, logs * (weight / (math.sqrt(logs @ logs) or 1.0))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (distinct, sorted) and values: words, word shapes and coarse measures of the whole text."""
    words = text.split()
    counts = Counter(words)
    shapes = Counter(_DIGIT.sub("9", _UPPER.sub("A", _LOWER.sub("a", text))).split())
    n, lines = max(1, len(words)), [line for line in text.split("\n") if line.strip()]
    kinds = np.bincount(_letter_kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=4)
    letters, capitals = int(kinds[1] + kinds[3]), int(kinds[2] + kinds[3])
    measures = (
        ("kinds", _step(len(counts) / n)),
        ("top", _step(max(counts.values(), default=0) / n)),
        ("lines", _step(len(set(lines)) / max(1, len(lines)))),
        ("letters", _step(letters / max(1, len(text)), 20)),
        ("upper", _step(capitals / max(1, letters))),
        ("length", min(20, n.bit_length())),
        ("word", min(20, int(len(text) / n))),
        ("again", _step(sum(map(eq, words, islice(words, 1, None))) / n)),
    )
    groups = (_group("w", counts, 1.0), _group("s", shapes, 1.0), _group("m", {f"{k}={v}": 1 for k, v in measures}, 1.5))
    places, values = map(np.concatenate, zip(*groups))
    buckets, inverse = np.unique(places, return_inverse=True)
    return buckets.astype(np.int32), np.bincount(inverse, values).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def position(self, text: str) -> float:
        buckets, values = features(text)
        return float(values @ self.weights[buckets])

    def tails(self, position: float) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - position, -50, 50)))


def graded(labels: DataFrame, quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: poor; 1: good but toxic; 2: good and not known to be toxic.  Null without a quality."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality) > 0, F.when(F.col(toxic) > 0, 1).otherwise(2)).cast("int")


def _featured(sample: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32())), batch.column(1)],
                names=["buckets", "values", "grade"],
            )

    return small_batches(sample).select("text", "grade").mapInArrow(made, "buckets array<int>, values array<float>, grade int")


def _sums(rows: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and its slopes by weight and by threshold, summed over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, thresholds))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        loss, by_weight, by_cut = 0.0, np.zeros(len(w)), np.zeros(len(cuts))
        for batch in batches:
            lists = batch.column(0)
            starts = np.asarray(lists.offsets)
            at = lists.flatten().to_numpy()
            values = batch.column(1).flatten().to_numpy().astype(float)
            owner = np.repeat(np.arange(len(batch)), np.diff(starts))
            grade = batch.column(2).to_numpy()
            position = np.bincount(owner, values * w[at], len(batch))
            with np.errstate(over="ignore"):
                high = 1 / (1 + np.exp(position - edges[grade + 1]))
                low = 1 / (1 + np.exp(position - edges[grade]))
            p = np.maximum(high - low, 1e-12)
            loss -= float(np.log(p).sum())
            by_weight += np.bincount(at, values * (1 - high - low)[owner], len(w))
            for k in range(len(cuts)):
                by_cut[k] -= float((high * (1 - high) / p)[grade == k].sum() - (low * (1 - low) / p)[grade == k + 1].sum())
        yield pa.RecordBatch.from_pydict({"loss": [loss], "w": [by_weight.tobytes()], "t": [by_cut.tobytes()]})

    loss, by_weight, by_cut = 0.0, np.zeros(len(weights)), np.zeros(len(thresholds))
    for part in rows.mapInArrow(summed, "loss double, w binary, t binary").collect():  # one row a task, ``TASKS`` at most
        loss += part[0]
        by_weight += np.frombuffer(part[1])
        by_cut += np.frombuffer(part[2])
    shared.destroy()
    return loss, by_weight, by_cut


def in_held_out(key: str = "doc_id") -> Column:
    """Rows that the fit never sees."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grades: int = GRADES, most: int = SAMPLE_ROWS) -> Model:
    """The model of ``ratings (key, grade)``, grades 0 to ``grades`` - 1, that are not held out.

    Null keys and grades are left out; a key rated twice has its lower grade.  Without ratings
    all weights are zero and every grade is as likely.
    """
    known = ratings.where(F.col("grade").isNotNull() & F.col(key).isNotNull() & ~in_held_out(key))
    ids = known.groupBy(F.col(key).alias("k")).agg(F.min("grade").cast("int").alias("grade"))
    chosen = ids.orderBy(F.xxhash64("k", F.lit(5)), "k").limit(most)  # a bounded sample, so it may be broadcast
    sample = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "k")
    tasks = min(TASKS, docs.sparkSession.sparkContext.defaultParallelism)
    rows = materialize(_featured(sample).repartition(tasks), "rated")
    share = {g: n for g, n in rows.groupBy("grade").count().collect()}
    total = sum(share.values())
    below = [(sum(share.get(g, 0) for g in range(k + 1)) + k + 1) / (total + grades) for k in range(grades - 1)]
    weights, cuts = np.zeros(BUCKETS), np.array([math.log(b / (1 - b)) for b in below])
    if not total:
        return Model(weights, cuts)
    small_batches(rows, 5_000)
    free = np.concatenate((weights, cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))))  # gaps by their logarithm keep the order
    mean, square = np.zeros(len(free)), np.zeros(len(free))
    for step in range(1, STEPS + 1):
        weights, cuts = _parts(free)
        _, by_weight, by_cut = _sums(rows, weights, cuts)
        after = np.cumsum(by_cut[::-1])[::-1]  # a gap moves all thresholds after it
        slope = np.concatenate((by_weight / total + RIDGE * weights, after[:1] / total, after[1:] * np.diff(cuts) / total))
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        free = free - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(*_parts(free))


def _parts(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return free[:BUCKETS], free[BUCKETS] + np.concatenate(([0.0], np.cumsum(np.exp(free[BUCKETS + 1 :]))))


def with_grades(
    docs: DataFrame, model: Model, text: str = "text", keep_from: int = KEEP_FROM, keep_probability: float = KEEP_PROBABILITY
) -> DataFrame:
    """``docs`` without ``text`` and with ``position``, ``expected_grade``, ``tail_probability`` and ``selected``.

    The whole text counts; null texts are read as empty ones.  Columns with these names are
    replaced.  Repeated rows give repeated rows, an empty table an empty table.
    """
    names = ("position", "expected_grade", "tail_probability", "selected")
    kept = [c for c in docs.columns if c not in (text, *names)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[f"`{c}`" for c in kept]).withColumns({**{n: F.lit(0.0) for n in names[:3]}, "selected": F.lit(True)}).schema

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = [shared.value.position(t or "") for t in batch.column(len(kept)).to_pylist()]
            tails = [shared.value.tails(p) for p in positions]
            tail = [float(t[keep_from - 1]) for t in tails]
            columns = [pa.array(positions, pa.float64()), pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array(tail, pa.float64())]
            columns.append(pa.array([t >= keep_probability for t in tail], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], names=[*kept, *names])

    return small_batches(docs).select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(marked, schema)
