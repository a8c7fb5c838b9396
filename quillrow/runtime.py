"""Helpers that tie the package to a running session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import quillrow

#: Paths of intermediate results; folders of local sessions, by application.
_SCRATCH: list[str] = []
_LOCAL: dict[str, str] = {}
#: Of the driver's largest heap; beyond this share, what is done is swept after a step.
HEAP_SHARE = 0.5


def ship() -> None:
    """Send this package's Python functions to the workers by value.

    Workers do not see the driver's ``sys.path``; pickling by value spares them the import.
    """
    if quillrow.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(quillrow)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: ``spark.checkpoint.dir``.

    Where that setting is unset a folder on this machine is chosen for local sessions; others are refused, as their
    executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL:
            _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="quillrow-", dir=os.environ.get("TMPDIR"))
        found = _LOCAL[name]
    return found


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the tables and containers written as intermediate results so far; how many is returned.

    Results that were not yet computed or written elsewhere may still need them. Spark's own checkpoints go with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    jvm, done = spark.sparkContext._jvm, 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        done += 1
    return done


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint(eager=True)
    relieve(df.sparkSession)
    return out


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A checkpointed ``df`` in as many partitions as it fills with ``rows`` rows each, at most as many as now.

    A shuffle leaves its number of partitions however few rows come out of it, and each step that reads them runs, and
    the driver keeps the books of, a task for each.
    """
    now = df.rdd.getNumPartitions()
    n = df.coalesce(-(-now // 32) or 1).count()
    return df.coalesce(min(now, -(-n // rows)) or 1)


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files, broadcasts and checkpoints of steps that are done; it does so when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> bool:
    """Sweeps if the driver's heap takes more than its share, and says whether it did.

    Each step leaves plans, task books and broadcasts behind. Left alone the heap grows to its largest size over a long
    query, however little of it is in use; a full collection gives back what is free.
    """
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    full = heap.totalMemory() > HEAP_SHARE * heap.maxMemory()
    if full:
        sweep(spark)
    return full


def materialize(df: DataFrame) -> DataFrame:
    """Like ``checkpoint`` for wide rows: a compressed table in the shared folder."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    relieve(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
