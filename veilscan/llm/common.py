"""What the operators of this subpackage share: inputs, stored tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder that all executors share.

    Only a local session may lack the setting; it then gets a folder in its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = f"{local_base(spark)}/llm-work"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_BASES: dict[str, str] = {}


def local_base(spark: SparkSession) -> str:
    """The folder of one local session, removed when the interpreter ends."""
    import tempfile

    app = spark.sparkContext.applicationId
    if app not in _BASES:
        folder = tempfile.TemporaryDirectory(prefix="llm-")
        _KEPT.append(folder)
        _BASES[app] = folder.name
    return _BASES[app]


_KEPT: list = []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB for this session, unless it has a setting of its own.

    A batch is held by the JVM and by the Python worker, going in and coming out; Spark's own
    bound would let texts take many times the memory that an operator itself needs.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ..., so that no added column can clash."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column out of the flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``limit`` bytes together, one row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(before, before[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def pooled(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in turn, in batches whose texts take about ``limit`` bytes together, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in byte_slices(whole, column, limit):
            # Rows without a text take room, too.
            own = (pc.sum(pc.binary_length(batch.column(column))).as_py() or 0) + 32 * batch.num_rows
            if held and size + own > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(batch)
            size += own
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and others need the memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def single_thread() -> None:
    """Libraries called in a task use that task's core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
