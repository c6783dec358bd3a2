"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, tempfile.TemporaryDirectory] = {}
_SHIPPED: set[str] = set()
#: Rows that one task of a dealt-out table reads, at most about.
ROWS_PER_TASK = 250_000
#: Rows that one task of a scan may read, at most, for its table to be left as it is.
PACKED_ROWS = 1_000_000


def build_session(app: str = "farpoint", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC timestamps.

    Shuffle partitions are left to the cluster's own setting unless given here;
    adaptive execution coalesces small ones and splits skewed joins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for tables written between stages.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall
    back on a temporary folder: on a cluster the executors could not share one.
    """
    context = spark.sparkContext
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    app = context.applicationId
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.TemporaryDirectory(prefix="farpoint-", ignore_cleanup_errors=True)
        root = _LOCAL_SCRATCH[app].name
    return f"{root.rstrip('/')}/farpoint/{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives lost executors, and the rows are computed once
    however many later stages read them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder, once its results are used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows that come from fewer files than there should be tasks, dealt out to as many.

    For inputs that an iterative fit reads many times or that go through Arrow functions.
    What a task reads, or keeps, does not grow with the table.  An input of enough files is
    left as it is, without a shuffle, unless Spark packs so many of them, or so long a one,
    into a task that it reads more than ``PACKED_ROWS``.
    """
    rows, _, most = _by_task(df)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return df if len(df.inputFiles()) >= tasks and most <= PACKED_ROWS else df.repartition(tasks)


def scanned(df: DataFrame) -> DataFrame:
    """Rows as their scan gives them where it has work for all cores, else :func:`spread`.

    For inputs that are read in single passes, which keep nothing, beside a fit whose rows are
    dealt out by :func:`dealt`: each pass over a dealt-out table shuffles it anew.
    """
    rows, tasks, most = _by_task(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if tasks >= cores and most * cores <= 2 * rows else spread(df)


def dealt(df: DataFrame) -> DataFrame:
    """Rows that a fit keeps, dealt out where a task would keep over a tenth more than ``ROWS_PER_TASK``."""
    rows, _, most = _by_task(df)
    if 10 * most <= 11 * ROWS_PER_TASK:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def _by_task(df: DataFrame) -> tuple[int, int, int]:
    """Rows, tasks that have some, and the most of one."""
    by_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    return tuple(by_task.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first())


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package as a zip, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="farpoint-zip-")) / "farpoint"
    archive = shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
