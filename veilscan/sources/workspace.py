"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one named in ``spark.checkpoint.dir``.

    Where the setting is absent the session must be a local one (tests, notebooks):
    only then may a folder of this machine stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:  # removed with everything in it when the interpreter ends
            _LOCAL[app] = tempfile.TemporaryDirectory(prefix="veilscan-")
        base = _LOCAL[app].name
    return f"{base.rstrip('/')}/veilscan-{uuid.uuid4().hex}"


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB for this session, unless it has a setting of its own.

    A batch is held by the JVM and by the Python worker; Spark's own bound would let long texts take much memory.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")


#: Rows of a task, at most, in :func:`spread_rows`.
TASK_ROWS = 25_000


def spread_rows(df: DataFrame, source: DataFrame) -> DataFrame:
    """Deal rows out in turn, so that heavy work on each is in tasks of bounded length, at least two per core.

    For narrow rows that carry much work each: how many files, row groups or joined partitions they come from
    says nothing about it. ``source`` is the table they are made from, a row or so for each of its rows; it is
    counted, which for Parquet reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, -(-source.count() // TASK_ROWS)))


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a freshly read table enough partitions for all cores.

    Only for a plain scan. Tables with at least one split per core, which is any large
    one, are left alone; a small one in a single row group is dealt out in turn, so
    that heavy per-row work uses every core whatever its keys look like.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)
