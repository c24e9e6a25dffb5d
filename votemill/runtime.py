"""Session settings, durable intermediates, and distributed ranking."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # split a hot join key even where that costs one more exchange downstream
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Rows that Spark hands to a Python worker at once, in bytes.  Its own 64 MB takes a task's documents as one batch, which the executor
#: and the worker then hold several times over, twice as much where the whole row goes along with the text.
WORKER_BATCH = "4m"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators are designed for (all are runtime settings)."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def lean(spark: SparkSession) -> None:
    """Hand rows to the Python workers in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", WORKER_BATCH)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application; a session finds it on no path of theirs."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="votemill-"), "votemill-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


_run_folders: dict[str, str] = {}
_owned: dict[str, Callable[[], object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this run that all executors can reach: below the one that ``spark.checkpoint.dir`` names, else below the warehouse.

    Only a local-mode session (tests) may do without both, in a temporary
    folder.  On a cluster a folder on a local disk is not taken on trust, as
    the disk may be a mount that all share or one machine's own: rows that the
    executors write there have to come back (see :func:`_write_and_count`).
    """
    context = spark.sparkContext
    application, known = context.applicationId, _run_folders.get(context.applicationId)
    if known:
        return known
    local = context.master.startswith("local[") or context.master == "local"
    base = spark.conf.get("spark.checkpoint.dir", None) or (None if local else spark.conf.get("spark.sql.warehouse.dir"))
    folder = f"{base.rstrip('/')}/votemill-{application}-{uuid.uuid4().hex[:8]}" if base else tempfile.mkdtemp(prefix="votemill-")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    _owned[application] = lambda: files.delete(path, True)
    if not local and files.getUri().getScheme() == "file":
        tasks = 4 * context.defaultParallelism
        found = _write_and_count(spark, f"{folder}/reach", tasks)
        if found != tasks:
            clean(application)
            raise RuntimeError(f"{base} is not one folder for all executors ({found} of {tasks} rows came back); set spark.checkpoint.dir to a shared one")
    _run_folders[application] = folder
    return folder


def _write_and_count(spark: SparkSession, path: str, tasks: int) -> int:
    """How many rows come back of those that ``tasks`` tasks have written, one each."""
    spark.range(0, tasks, 1, tasks).write.parquet(path)
    return spark.read.schema("id long").parquet(path).count()


def clean(application: str) -> None:
    """Delete the folder of a run; every folder left goes at the end of the process."""
    _run_folders.pop(application, None)
    delete = _owned.pop(application, None)
    if delete:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
            delete()


@atexit.register
def _clean_all() -> None:
    for application in list(_owned):
        clean(application)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def listing(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Names, lengths and times of the files below each path, folders included; a digest for each path that exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def entries(path) -> str:
        files = path.getFileSystem(conf)
        found = jvm.scala.runtime.ScalaRunTime.stringOf(files.listStatus(path))  # one call for a folder, however many files
        inner = [entries(s.getPath()) for s in files.listStatus(path) if s.isDirectory()] if "isDirectory=true" in found else []
        return re.sub(r"access_time=\d+", "", found) + "".join(inner)

    out = {}
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            out[path] = hashlib.sha256(entries(place).encode()).hexdigest()
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    return saved(df, fresh_path(df.sparkSession, name))


def saved(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written to a new folder and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the scan has fewer tasks than the cluster has cores, as with one small file; large tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def global_rank(df: DataFrame, group: str, value: str, tiebreak: str, rank: str = "rank0", total: str = "total") -> DataFrame:
    """Zero-based rank of ``(value, tiebreak)`` inside each ``group``, for groups of any size.

    A plain window would sort a whole group in one task.  Here the rows are
    dealt by range, numbered within their range, and shifted by the sizes of
    the group's ranges before it; ties are cut too, so one value held by a
    third of the rows is still spread out.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, group, value, tiebreak).withColumn("_range", F.spark_partition_id())
    keyed = materialize(ranged, "ranges")
    sizes = keyed.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row for each range of a group reaches these windows
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(W.partitionBy(group)).alias(total))
    within = W.partitionBy(group, "_range").orderBy(value, tiebreak)
    return (keyed.withColumn("_rn", F.row_number().over(within)).join(shifts, [group, "_range"])
            .withColumn(rank, F.col("_shift") + F.col("_rn") - 1).drop("_range", "_rn", "_shift"))


def running_total(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its ``group``, for groups of any size (see :func:`global_rank`)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id())
    keyed = materialize(ranged, "ranges")
    sizes = keyed.groupBy(group, "_range").agg(F.sum(value).alias("_n"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = W.partitionBy(group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (keyed.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
            .join(shifts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
            .withColumn(name, F.col("_shift") + F.col("_own")).drop("_range", "_own", "_shift", "_group", "_of"))
