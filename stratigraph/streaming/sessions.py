"""Session events: replay, summaries and debounce, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "session_id string, event_id long, event_type string, occurred_at timestamp, value double"


def replay(events: DataFrame, after: int, limit: int = 1000) -> DataFrame:
    """The next limit events of each session behind a sequence number, and whether there are more."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit out of bounds")
    w = Window.partitionBy("session_id").orderBy("sequence_number")
    rest = events.where(F.col("sequence_number") > after).withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit + 1)
    return rest.withColumn("has_more", F.max("k").over(Window.partitionBy("session_id")) > limit).where(F.col("k") <= limit).drop("k")


def summary(events: DataFrame, end_type: str) -> DataFrame:
    """(session_id, event_count, last_sequence, ended_at)."""
    return events.groupBy("session_id").agg(F.count("*").alias("event_count"), F.max("sequence_number").alias("last_sequence"), F.max(F.when(F.col("event_type") == end_type, F.col("occurred_at"))).alias("ended_at"))


def debounce(changes: DataFrame, gap: str = "750 milliseconds") -> DataFrame:
    """(session_id, started_at, changes): bursts of changes with pauses shorter than gap; the same on a stream behind a watermark."""
    return changes.groupBy("session_id", F.session_window("occurred_at", gap).alias("w")).agg(F.count("*").alias("changes")).select("session_id", F.col("w.start").alias("started_at"), "changes")


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 8) -> DataFrame:
    """A stream of event files; back-pressure is by files per trigger, so nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event of a session once, as long as a repeat comes within the watermark."""
    return stream.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["session_id", "event_id"])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into files beside its checkpoint, and gives their rows."""
    path = f"{checkpoint}-{name}"
    query = stream.writeStream.format("parquet").option("path", path).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
