"""Streams over the append-only flows: fetch events and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import HISTORY_COLUMNS, recent_fetches, upsert_history
from ..sources.readers import RUN_LOG, parse_run_log


HISTORY_SCHEMA = (
    "normalized_url STRING, url STRING, source_domain STRING, page_type STRING, last_seen_at TIMESTAMP, "
    "last_fetched_at TIMESTAMP, last_search_query STRING, last_error STRING, candidate_id STRING, "
    "candidate_name STRING"
)


BUCKETS = 64  # of a history table


def stream_history(
    updates: DataFrame, table: str, checkpoint: str, suppressed: str | None = None, available_now: bool = True,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the history table current from a stream of fetch events.

    The table is cut into buckets by URL. A batch folds its updates into the buckets that they touch, writes these
    below its own number (``v=<batch>/b=<bucket>``), and then a list of each bucket's newest version
    (``versions/v=<batch>``). A batch that runs again after a failure starts from the list of the batch before and gives the same files. With
    ``suppressed`` the events that came within the TTL of their URL's record at that moment are written as well, the
    same ones however the stream is cut into batches.
    """
    spark = updates.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.filter(F.coalesce("normalized_url", F.lit("")) != "").withColumn("b", _bucket(buckets))
        touched = [r["b"] for r in keyed.select("b").distinct().collect()]  # at most a row per bucket
        versions = _versions(spark, table, batch_id)
        before = _read(spark, table, {b: versions[b] for b in touched if b in versions})
        if suppressed:
            flagged = recent_fetches(before, batch.select(*HISTORY_COLUMNS, "ord"))
            flagged.filter("skip").write.mode("overwrite").parquet(f"{suppressed}/v={batch_id}")
        after = upsert_history(before, batch.select(*HISTORY_COLUMNS, "ord")).withColumn("b", _bucket(buckets))
        after.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{table}/v={batch_id}")
        versions |= dict.fromkeys(touched, batch_id)
        rows = spark.createDataFrame(sorted(versions.items()), VERSION_SCHEMA)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{table}/versions/v={batch_id}")

    writer = updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


VERSION_SCHEMA = "b INT, v LONG"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("normalized_url"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, table: str, batch_id: int) -> dict[int, int]:
    """Newest version of each bucket before a batch; the stream has always finished the batch before."""
    if batch_id == 0:
        return {}
    rows = spark.read.schema(VERSION_SCHEMA).parquet(f"{table}/versions/v={batch_id - 1}")
    return {r["b"]: r["v"] for r in rows.collect()}


def _read(spark: SparkSession, table: str, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(*[f"{table}/v={v}/b={b}" for b, v in sorted(versions.items())])


def read_history(spark: SparkSession, table: str, batch_id: int) -> DataFrame:
    """The history table as it stood after a batch."""
    return _read(spark, table, _versions(spark, table, batch_id + 1))


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.schema(RUN_LOG).option("mode", "DROPMALFORMED").json(path)
    return parse_run_log(raw).filter(F.col("ts").isNotNull())


def hourly_runs(log: DataFrame, delay: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Runs, errors, imports and reasons per hour and mode.

    On a stream, rows later than the watermark are dropped; on a table the
    watermark has no effect and the same counts come out.
    """
    if log.isStreaming:
        log = log.withWatermark("ts", delay)
    return log.groupBy(F.window("ts", width).alias("w"), "mode", "reason").agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.sum(F.coalesce("imported", F.lit(0))).alias("n_imported"),
    ).select(F.col("w.start").alias("hour"), "mode", "reason", "n_runs", "n_errors", "n_imported")


def stream_run_log(log: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = hourly_runs(log).writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
