"""Ingest stream: lines in; log table, dead letters and detection feed out."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, stats
from ..schema import LOG_COLUMNS, PARTITION_COLUMNS
from ..sources.logs import with_partitions
from ..sources.stream_table import StreamTable

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 10.0


def read_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Text files of JSON lines, as they arrive."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None,
               **options) -> DataFrame:
    """Messages of a topic, by default all that have arrived. Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def keep_trying(write: Callable[[], None], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT,
                sleep=time.sleep) -> Exception | None:
    """Run a write, with doubled pauses between attempts; the last error if all of them failed."""
    error = None
    for attempt in range(attempts):
        if attempt:
            sleep(min(first_wait * 2 ** (attempt - 1), LONGEST_WAIT))
        try:
            write()
            return None
        except Exception as failure:  # noqa: BLE001  (whatever fails goes to the dead letters)
            error = failure
    return error


def ingest_stream(lines: DataFrame, table: str, dead_letters: str, checkpoint: str,
                  detection_feed: str | None = None, as_of=None, value: str = "value",
                  on_metrics: Callable[[int, dict], None] | None = None,
                  trigger: dict | None = None, keep_seconds: float = 3600.0) -> StreamingQuery:
    """Start the stream. One parse feeds all sinks, which are stream tables: a micro-batch that is replayed changes
    nothing where it was committed. Full levels are compacted on the way; merged files go after ``keep_seconds``."""
    spark = lines.sparkSession
    logs = StreamTable(spark, table, PARTITION_COLUMNS)
    letters = StreamTable(spark, dead_letters)
    feed = StreamTable(spark, detection_feed) if detection_feed is not None else None

    def process(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        rows = ingest.ingest(batch, as_of, value).observe(
            seen,
            F.count(F.lit(1)).alias("total"),
            F.count_if("is_valid").alias("success"),
            F.count_if(~F.col("is_valid")).alias("failed"),
        ).persist()
        try:
            valid = with_partitions(rows.filter("is_valid")).select(*LOG_COLUMNS, "ts_fallback", "log_date")
            error = keep_trying(lambda: logs.append(valid, batch_id))
            bad = rows.filter("not is_valid").select("raw_value", "reject_reason")
            if error is not None:
                reason = F.lit(f"write failed: {type(error).__name__}")
                bad = bad.unionByName(rows.filter("is_valid").select("raw_value", reason.alias("reject_reason")))
            letters.append(bad.withColumn("rejected_at", F.current_timestamp()), batch_id)
            if feed is not None and error is None:
                # one key on one partition; rows without a trace have no order to keep and are spread
                trace = F.coalesce("trace_id", F.xxhash64(*LOG_COLUMNS).cast("string"))
                feed.append(valid.repartition("tenant_id", "system_id", trace), batch_id, placed=True)
            if on_metrics is not None:
                on_metrics(batch_id, seen.get)
        finally:
            rows.unpersist()
        for sink in filter(None, (logs, letters, feed)):
            if (batch_id + 1) % sink.fan == 0:
                sink.tidy()
                sink.vacuum(keep_seconds)

    return (
        lines.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def drop_replayed(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop rows whose id was seen within the watermark; the first one stays."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def counts_stream(logs: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts by event time; rows behind the watermark are dropped and counted by Spark."""
    return stats.counts_per_window(logs.withWatermark("ts", delay), width)
