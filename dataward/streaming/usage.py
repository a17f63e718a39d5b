"""Usage events and requests as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dataward.functions.canonical import at_instant
from dataward.operators.usage import MAXIMUM_AGE_DAYS, MAXIMUM_SKEW_SECONDS, dedupe_checked


def stream_rollup(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Hourly totals of a stream; an hour is emitted once the watermark has passed it.

    ``occurred_at`` must be a timestamp with time zone meaning, as watermarks need one.
    """
    hours = events.withWatermark("occurred_at", delay).groupBy(
        F.window("occurred_at", "1 hour"), "component", "tenant_id", "meter_name", "purpose", "unit", "dimensions_sha256")
    return hours.agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("event_count")).select(
        "component", "tenant_id", "meter_name", "purpose", "unit", F.col("window.start").alias("period_start"), "dimensions_sha256",
        "quantity", "event_count", F.lit(3600).alias("period_seconds"))


def stream_sli(requests: DataFrame, threshold: float = 500, delay: str = "10 minutes") -> DataFrame:
    """Indicator counts over five minutes, moving by one; longer windows are batch work."""
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes", "1 minute"), "service").agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("outcome") == "error").alias("server_error_count"),
        F.count("duration_ms").alias("latency_eligible_count"), F.count_if(F.col("duration_ms") <= threshold).alias("latency_good_count")).select(
        "service", F.col("window.end").alias("at"), "request_count", "server_error_count", "latency_eligible_count", "latency_good_count")


def stream_dedupe(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """First event of each key within the watermark; older repeats are caught by ``record_usage``."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(keys)


def record_usage(batch: DataFrame, ledger_path: str, rejects_path: str, now, batch_no: int) -> None:
    """Store one micro-batch: late, future and conflicting events go to the rejects, replays nowhere.

    The ledger holds one folder per micro-batch, so a repeated micro-batch replaces its own rows. The
    events already there decide what is a replay, however old it is.
    """
    spark = batch.sparkSession
    clock = at_instant(now)
    at = F.col("occurred_at").cast("timestamp_ntz")
    timely = at.between(clock - F.make_dt_interval(F.lit(MAXIMUM_AGE_DAYS)), clock + F.make_dt_interval(secs=F.lit(MAXIMUM_SKEW_SECONDS)))
    keys = ["component", "tenant_id", "event_id"]
    seen = _existing(spark, ledger_path, [*keys, "event_sha256"], batch_no)
    # The event time comes first in the order, so the earliest copy binds the key.
    outcome = dedupe_checked(batch.where(timely), keys, "event_sha256", ["occurred_at", "event_sha256"], seen)
    fresh = outcome.where(F.col("outcome") == "inserted").dropDuplicates(keys)
    fresh.drop("outcome").write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_no:012d}")
    late = batch.where(~F.coalesce(timely, F.lit(False))).withColumn("outcome", F.lit("out-of-range"))
    late.unionByName(outcome.where(F.col("outcome") == "conflict")).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_no:012d}")


def _existing(spark, path: str, cols: list[str], batch_no: int) -> DataFrame | None:
    """Ledger rows of earlier micro-batches, None when there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop) or not any(s.isDirectory() for s in files.listStatus(hadoop)):
        return None
    return spark.read.parquet(path).where(F.col("batch") < batch_no).select(*cols)


def start_recording(events: DataFrame, ledger_path: str, rejects_path: str, checkpoint: str, now) -> StreamingQuery:
    return (events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, n: record_usage(df, ledger_path, rejects_path, now, n)).start())
