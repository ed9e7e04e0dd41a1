"""Session set-up and the checkpoint helper used by round loops."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "oppweave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("OPPWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage; the shuffle files that led to it go.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session
    without one gets a folder of its own; on a cluster a machine-local folder
    would not survive the loss of an executor, so that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            path = tempfile.mkdtemp(prefix="oppweave-ckpt-")
        sc.setCheckpointDir(path)
    before = spark.conf.get(SPENT, None)
    spark.conf.set(SPENT, "true")
    try:
        # In a plan of its own: the shuffles of ``df`` itself may be read again.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(SPENT) if before is None else spark.conf.set(SPENT, before)


#: Rows up to which a table of keys goes to every task by a broadcast.
NEAR = 500_000


def near(df: DataFrame) -> DataFrame:
    """A written-out table of keys, marked for a broadcast if it has at most ``NEAR`` rows."""
    return F.broadcast(df) if df.count() <= NEAR else df


#: Session setting of benchmarks: partitions for test tables whose files are one row group each.
SPLITS = "spark.oppweave.testTableSplits"


#: Narrow rows, each of which costs a task much work, that one task should get.
ROWS_PER_TASK = 4000


def split_rows(df: DataFrame) -> DataFrame:
    """Deal the rows of a test table to as many partitions as the session says; without the setting the scan's own stay.

    Tables of many files or row groups are split by the scan, and moving their texts would only cost.
    """
    n = int(df.sparkSession.conf.get(SPLITS, "0"))
    return df.repartition(n) if n else df


def deal_rows(df: DataFrame, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal narrow rows that become pages or documents to tasks of about ``per_task`` rows, or as the session says.

    A file of one row group is one task of the scan however many rows it has, and all work on the
    pages written from them would stay in that task. The rows are counted from the file's footers.
    """
    n = int(df.sparkSession.conf.get(SPLITS, "0")) or -(-df.count() // per_task)
    return df.repartition(n) if n > 1 else df


#: Rows of the largest of several tables that one task should bring together by a key; up to ``DIRECT`` tasks, to which
#: Spark writes rows without holding them, then ``MOST_KEYED`` times as many.
KEYED_ROWS, DIRECT, MOST_KEYED = 100_000, 200, 20


def deal_keyed(*tables: tuple[DataFrame, str], per_task: int | None = None) -> list[DataFrame]:
    """Deal tables by the column on which they meet, to the same tasks of about ``per_task`` rows of the largest.

    Left to itself a task gets what 64 MB of compressed shuffle hold, which sorted and counted may take twenty times as
    much. The rows are counted from the files' footers.
    """
    rows, per_task = max(df.count() for df, _ in tables), per_task or KEYED_ROWS
    n = max(min(-(-rows // per_task), DIRECT), -(-rows // (per_task * MOST_KEYED)))
    return [df.repartition(n, key) if n > 1 else df for df, key in tables]
