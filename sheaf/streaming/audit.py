"""The audit log as a stream: records are appended as they come (S11), counts per window follow behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What is recorded; an answer's text never is.
FIELDS = ("at", "client", "config", "question", "context_chunk_ids", "abstained", "latency_ms", "error")


def audit_log(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of answers to JSON lines, exactly once."""
    kept = [c for c in FIELDS if c in answers.columns]
    return answers.select(*kept).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and event type: number and mean value; events that are late by more than the watermark are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")
