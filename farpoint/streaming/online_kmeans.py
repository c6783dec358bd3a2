"""Streaming k-means, scoring and feedback on directories of delimited files.

The state is a table of centres per batch: batch b reads version b and writes version
b+1, so a batch that is run again after a failure gives the same state.  A pointer names the
newest version and old ones are packed into one table a hundred, so a batch costs the same
however many came before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from farpoint.operators.evaluate import outcome
from farpoint.operators.kmeans import Centers, cluster_sums
from farpoint.sources.records import numeric_schema, write_delimited


def training_stream(spark: SparkSession, paths: str, dims: int, **options: str) -> DataFrame:
    """Unlabelled rows of ``dims`` numbers as ``features``; ``paths`` may be a glob."""
    rows = spark.readStream.schema(numeric_schema(dims)).options(mode="FAILFAST", **options).csv(paths)
    return rows.select(F.array(*rows.columns).alias("features"))


def testing_stream(spark: SparkSession, paths: str, dims: int, **options: str) -> DataFrame:
    """Rows with the numeric label first: ``(label, features)``."""
    schema = T.StructType([T.StructField("label", T.DoubleType()), *numeric_schema(dims).fields])
    rows = spark.readStream.schema(schema).options(mode="FAILFAST", **options).csv(paths)
    return rows.select("label", F.array(*rows.columns[1:]).alias("features"))


def label_first(fields: Column) -> tuple[Column, Column]:
    """Label and features of a split line whose label comes first."""
    numbers = F.transform(fields, lambda x: x.cast("double"))
    return F.element_at(numbers, 1), F.slice(numbers, F.lit(2), F.size(fields) - 1)


@dataclass(frozen=True)
class State:
    """Versioned centre tables below ``path``.

    Version n is the folder ``v<n>`` until it is older than the next ``pack`` versions; then those
    of its hundred lie in ``log/c<n // pack>``.  The two newest versions are always folders, as a
    batch that is run again needs them.  The pointer is written after a version and may lag behind
    it, never run ahead.
    """

    spark: SparkSession
    path: str
    pack: int = 100

    def start(self, centers: np.ndarray, weights: np.ndarray | None = None) -> None:
        """Write version 0."""
        self._write(0, centers, np.zeros(len(centers)) if weights is None else weights)

    def start_random(self, k: int, dims: int, seed: int = 1, weight: float = 0.0) -> None:
        """Version 0 with standard normal centres."""
        centers = np.random.default_rng(seed).normal(size=(k, dims))
        self.start(centers, np.full(k, weight))

    def read(self, version: int) -> tuple[np.ndarray, np.ndarray]:
        centers, weights, _ = self._read(version)
        return centers, weights

    def latest_version(self) -> int:
        """The newest version whose write has finished: the pointer's, or one that has come since."""
        version = self._pointer()
        if version is None:  # never written, or just being written
            version = max(n for n in self._numbers(self.path, "v"))
        while _is_complete(self.spark, self._folder(version + 1)):
            version += 1
        return version

    def snapshot(self, version: int | None = None) -> Centers:
        """Current centres, or those of one version; readable while training goes on."""
        return Centers(self.read(self.latest_version() if version is None else version)[0])

    def history(self) -> DataFrame:
        """``(version, cluster, center, weight, seen, rows)`` of all versions.

        ``seen`` is how many rows all batches up to the version had, ``rows`` those of its own.
        """
        packed = set(self._numbers(f"{self.path}/log", "c"))
        single = [n for n in self._numbers(self.path, "v") if n // self.pack not in packed]
        chunks = [self._chunk(n) for n in sorted(packed)]
        return self.spark.read.parquet(*chunks, *[self._folder(n) for n in sorted(single)])

    def dumps(self, every: int = 100) -> DataFrame:
        """The history at the versions in whose batch the rows seen passed a multiple of ``every``."""
        step = F.lit(every)
        passed = F.floor(F.col("seen") / step) > F.floor((F.col("seen") - F.col("rows")) / step)
        return self.history().filter(passed)

    def _read(self, version: int) -> tuple[np.ndarray, np.ndarray, int]:
        chunk = self._chunk(version // self.pack)
        table = chunk if _is_complete(self.spark, chunk) else self._folder(version)
        rows = self.spark.read.parquet(table).filter(F.col("version") == version).orderBy("cluster").collect()
        centers, weights = [r.center for r in rows], [r.weight for r in rows]
        return np.array(centers, dtype=float), np.array(weights, dtype=float), rows[0].seen

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def _chunk(self, number: int) -> str:
        return f"{self.path}/log/c{number}"

    def _write(self, version: int, centers: np.ndarray, weights: np.ndarray, seen: int = 0, batch_rows: int = 0) -> None:
        rows = [
            (version, i, [float(v) for v in c], float(w), int(seen), int(batch_rows))
            for i, (c, w) in enumerate(zip(centers, weights))
        ]
        schema = "version int, cluster int, center array<double>, weight double, seen long, rows long"
        table = self.spark.createDataFrame(rows, schema)
        table.coalesce(1).write.mode("overwrite").parquet(self._folder(version))
        fs, path = _file_system(self.spark, f"{self.path}/LATEST")
        out = fs.create(path, True)
        out.writeBytes(str(version))
        out.close()
        if version > self.pack and version % self.pack == 1:
            self._pack_up(version // self.pack - 1)

    def _pack_up(self, number: int) -> None:
        """Move the versions of one chunk into one table; done again, it only clears what is left."""
        folders = [self._folder(n) for n in range(number * self.pack, (number + 1) * self.pack)]
        if not _is_complete(self.spark, self._chunk(number)):
            self.spark.read.parquet(*folders).coalesce(1).write.mode("overwrite").parquet(self._chunk(number))
        for folder in folders:
            fs, path = _file_system(self.spark, folder)
            fs.delete(path, True)

    def _pointer(self) -> int | None:
        fs, path = _file_system(self.spark, f"{self.path}/LATEST")
        try:
            file = fs.open(path)
            try:
                return int(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
            finally:
                file.close()
        except (Py4JJavaError, ValueError):
            return None

    def _numbers(self, folder: str, letter: str) -> list[int]:
        """Numbers of the finished tables in a folder that are named by a letter and a number."""
        fs, path = _file_system(self.spark, folder)
        names = [entry.getPath().getName() for entry in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(name[1:]) for name in names if name[0] == letter and name[1:].isdigit()]
        return [n for n in numbers if _is_complete(self.spark, f"{folder}/{letter}{n}")]


def half_life(length: float) -> float:
    """The decay by which a weight halves in ``length`` batches or points."""
    return 0.5 ** (1.0 / length)


def split_dying(
    centers: np.ndarray, weights: np.ndarray, least: float = 1e-8, nudge: float = 1e-14
) -> tuple[np.ndarray, np.ndarray]:
    """The lightest centre, where it weighs less than ``least`` of the heaviest, moved next to that one.

    The two share their weight and stand apart by ``nudge``, relative for coordinates beyond 1, on
    either side of where the heaviest was.
    """
    heavy, light = int(weights.argmax()), int(weights.argmin())
    if not weights[light] < least * weights[heavy]:
        return centers, weights
    centers, weights = centers.copy(), weights.copy()
    apart = nudge * np.maximum(np.abs(centers[heavy]), 1.0)
    centers[light], centers[heavy] = centers[heavy] - apart, centers[heavy] + apart
    weights[light] = weights[heavy] = (weights[light] + weights[heavy]) / 2
    return centers, weights


def fold(
    centers: np.ndarray, weights: np.ndarray, batch: DataFrame, decay: float = 1.0, unit: str = "batches"
) -> tuple[np.ndarray, np.ndarray]:
    """State after a batch: ``c' = (c*n*a + sum) / (n*a + m)``, ``n' = n*a + m``.

    ``a`` is ``decay``, or with ``unit`` "points" its power by the rows of the batch.
    """
    return _fold(centers, weights, batch, decay, unit)[:2]


def _fold(centers, weights, batch, decay, unit) -> tuple[np.ndarray, np.ndarray, int]:
    if unit not in ("batches", "points"):
        raise ValueError(f"unit must be batches or points, not {unit!r}")
    sums = cluster_sums(batch.select("features"), centers).collect()  # one row a cluster
    rows = sum(row.n for row in sums)
    moved, kept = centers.copy(), weights * (decay if unit == "batches" else decay**rows)
    for row in sums:
        i, n = row.cluster, kept[row.cluster]
        moved[i] = (centers[i] * n + np.asarray(row.total)) / (n + row.n)
        kept[i] = n + row.n
    return moved, kept, rows


def train_on(
    stream: DataFrame,
    state: State,
    checkpoint: str,
    decay: float = 1.0,
    trigger: dict | None = None,
    unit: str = "batches",
    nudge: float | None = None,
) -> StreamingQuery:
    """Update the centres with every batch.  A state belongs to one checkpoint.

    With ``nudge`` a centre that dies is moved next to the heaviest one (``split_dying``).
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            centers, weights, seen = state._read(batch_id)
            centers, weights, n = _fold(centers, weights, rows, decay, unit)
            if nudge is not None:
                centers, weights = split_dying(centers, weights, nudge=nudge)
            state._write(batch_id + 1, centers, weights, seen + n, n)
        finally:
            rows.unpersist()

    return _start(stream, update, checkpoint, trigger)


def score_rows(rows: DataFrame, centers: Centers, threshold: float = 75000.0) -> DataFrame:
    """Add ``cluster``, ``sq_distance``, ``judged`` and ``outcome`` (positive = attack)."""
    assigned = centers.assign(rows)
    judged = F.col("sq_distance") < threshold
    return assigned.withColumns(
        {
            "judged": F.when(judged, "normal").otherwise("attack"),
            "outcome": outcome(F.col("label") == 0.0, judged, positive="attack"),
        }
    )


def score_on(
    stream: DataFrame,
    state: State,
    checkpoint: str,
    results: str,
    feedback: str | None = None,
    threshold: float = 75000.0,
    version: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Judge every row by the newest centres (or one fixed ``version``).

    Outcomes go to ``results/b<batch>``.  Rows judged normal also go, as text, to
    ``feedback/b<batch>``, from where the training stream can take them up.  A batch that
    is run again leaves a finished folder alone, so nothing is fed back twice.
    """
    spark = state.spark

    def judge(batch: DataFrame, batch_id: int) -> None:
        out, back = f"{results}/b{batch_id}", f"{feedback}/b{batch_id}"
        if not _is_complete(spark, out):
            scored = score_rows(batch, state.snapshot(version), threshold).withColumn("batch", F.lit(batch_id))
            scored.write.mode("overwrite").parquet(out)
        if feedback and not _is_complete(spark, back):
            normal = spark.read.parquet(out).filter(F.col("judged") == "normal")
            write_delimited(normal.select("features"), back, mode="overwrite")

    return _start(stream, judge, checkpoint, trigger)


def outcome_counts_on(
    stream: DataFrame, centers: Centers, name: str, checkpoint: str, threshold: float = 75000.0, trigger=None
) -> StreamingQuery:
    """Running outcome counts in a memory table, for fixed centres."""
    counts = score_rows(stream, centers, threshold).groupBy("outcome").agg(F.count("*").alias("n"))
    writer = counts.writeStream.format("memory").queryName(name).outputMode("complete")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_outcomes_on(
    stream: DataFrame,
    centers: Centers,
    checkpoint: str,
    results: str,
    width: str = "1 hour",
    delay: str = "1 day",
    time: str = "time",
    threshold: float = 75000.0,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Outcome counts per window of event time, as keyed state that a watermark bounds.

    A batch writes the counts that it changed to ``results/b<batch>``, in place of what an earlier
    run of it left, so a batch that is run again changes nothing.  A row may arrive late as long as
    its window ends after the watermark, the latest time of earlier batches less ``delay``; later
    ones are not counted, as their window's state is gone.  Rows without a time have no window.
    """
    scored = score_rows(stream.filter(F.col(time).isNotNull()).withWatermark(time, delay), centers, threshold)
    counts = scored.groupBy(F.window(time, width).alias("window"), "outcome").agg(F.count("*").alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("window.start", "window.end", "outcome", "n", F.lit(batch_id).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{results}/b{batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def windowed_outcomes(spark: SparkSession, results: str) -> DataFrame:
    """``(start, end, outcome, n)``: of every window and outcome the count of the last batch that changed it."""
    rows = spark.read.parquet(f"{results}/b*")
    return rows.groupBy("start", "end", "outcome").agg(F.max_by("n", "batch").alias("n"))


def _start(stream: DataFrame, action, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _is_complete(spark: SparkSession, folder: str) -> bool:
    fs, path = _file_system(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)
