"""Writers: candidate table, keyed upserts and run traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import upsert_offers, upsert_queue


def write_candidates(df: DataFrame, path: str) -> None:
    """Full rewrite of the candidate table.

    The new content must not be read from ``path`` itself: write it elsewhere first
    (``cut`` or another folder) when it derives from the old table.
    """
    df.write.mode("overwrite").parquet(path)


def upsert_tables(
    offers: DataFrame, queue: DataFrame, incoming: DataFrame, links: DataFrame, out: str
) -> tuple[str, str]:
    """Write both tables of the hosted store after an upsert, into a new version folder."""
    a, b = f"{out}/offers", f"{out}/queue"
    upsert_offers(offers, incoming).write.mode("overwrite").parquet(a)
    upsert_queue(queue, links).write.mode("overwrite").parquet(b)
    return a, b


def write_run_trace(trace: DataFrame, path: str, buckets: int = 64) -> None:
    """Trace rows of any kind, in one folder per round and bucket of runs.

    The folders of a written round's buckets are replaced, so a repeated job leaves no row twice; give all rows
    of a round and bucket at once. A bucket holds many runs, so files stay few however many runs there are.
    """
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")
    (
        trace.withColumn("run_bucket", bucket)
        .repartition("round", "run_bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("round", "run_bucket").parquet(path)
    )
