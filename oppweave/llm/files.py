"""Files and tables in the folder that driver and executors share."""

from __future__ import annotations

import struct
import tempfile
import uuid
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster
    its absence is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        app = spark.sparkContext.applicationId
        base = _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="oppweave-ckpt-"))
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") else base
    return f"{base.rstrip('/')}/oppweave-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 250, size: str = "4m", row_group: int = 16 << 20) -> None:
    """Bound what a task and its worker hold of the input and output at once, where the session has not been set otherwise.

    Spark's own bounds, 10,000 rows and 64 MB, are held by the executor and again, as objects, by the worker; a
    Parquet writer holds a row group, 128 MB by default.
    """
    for name, usual, wanted in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size),
        ("parquet.block.size", str(128 << 20), str(row_group)),
    ):
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, wanted)


def give_back() -> None:
    """Return a worker's free memory to the machine, before it waits for tasks of another kind."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`stored` that no plan will read any more; all that was made from them has been stored."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> BinaryIO:
    """A new file for sequential writing, by any URI that Arrow's file systems know."""
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # else .zst would be compressed once more


class Ranges:
    """A file that is read by byte ranges."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()

    def __call__(self, start: int, length: int) -> bytes:
        got = self._file.read_at(length, start)
        if len(got) != length:
            raise EOFError(f"{length} bytes wanted at {start}, {len(got)} found")
        return got

    def unpack(self, form: str, start: int) -> tuple:
        return struct.unpack(form, self(start, struct.calcsize(form)))

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *error) -> None:
        self._file.close()


def task_file(folder: str, suffix: str, part: int = 0) -> str:
    """A name that no other attempt of the task uses; only names that a finished task returns count."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{folder}/{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex}{suffix}"


def by_file(files: DataFrame, name: str) -> DataFrame:
    """A table of files, read by as many tasks as it has rows.

    The number is given, so that adaptive execution does not merge a table of few bytes into one partition.
    """
    return files.repartitionByRange(max(1, files.count()), name)
