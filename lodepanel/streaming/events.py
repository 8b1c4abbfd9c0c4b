"""Event streams: typed parsing, deduplication, event-time windows, and a dead-letter split with an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_files(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 8) -> DataFrame:
    """The `events` files of a folder as a stream, or the files in it if `pattern` names a folder; a batch takes a bounded number of files."""
    schema = EVENT.replace("ts timestamp", "ts timestamp_ntz")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    inner = f"{folder.rstrip('/')}/{pattern}"
    path = spark._jvm.org.apache.hadoop.fs.Path(inner)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(path) and files.getFileStatus(path).isDirectory():
        rows = stream.parquet(inner)
    else:
        rows = stream.option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def parse(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Typed events of JSON strings, and `error` for those that cannot be read or lack an id, time or type."""
    event = F.from_json(column, EVENT, {"mode": "PERMISSIVE"})
    rows = payloads.withColumn("event", event)
    bad = F.col("event.event_id").isNull() | F.col("event.ts").isNull() | F.col("event.event_type").isNull()
    return rows.select(F.col(column).alias("payload"), "event.*", F.when(bad, "unreadable or incomplete").alias("error"))


def once(events: DataFrame, delay: str | None = "1 hour", key: str = "event_id") -> DataFrame:
    """Each id once, with state that the watermark bounds (in a batch, or without `delay`: over all rows)."""
    if delay is None or not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events, users and value by type and window; late rows beyond `delay` are left out of a stream."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n_events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a user's events with less than `gap` between them."""
    runs = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return runs.agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")


def deliver(parsed: DataFrame, good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Readable events to `good`, the others with their reason to `dead`, each batch to a folder of its own.

    A batch that runs again after a failure overwrites its own folders: delivery is at least once, results are once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("error IS NULL").drop("payload", "error").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("error IS NOT NULL").select("payload", "error").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that `stream` (in append mode) has now, as a table."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
