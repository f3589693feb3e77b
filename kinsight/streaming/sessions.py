"""Live sessions: watermarked session windows, late rows set aside, closed sessions appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kinsight.functions.validation import split_valid


def live_sessions(events: DataFrame, gap_minutes: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """One row per closed session of a streaming frame; a session closes once the watermark passes its end and gap."""
    window = F.session_window("ts", f"{gap_minutes} minutes")
    made = events.withWatermark("ts", lateness).groupBy("account_id", "device_id", window.alias("w")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("event_count"), F.sum("duration_sec").alias("total_duration"),
        F.sum(F.when(F.col("conversion_value") > 0, F.col("conversion_value")).otherwise(0.0)).alias("conversion_value"),
    )
    return made.select("account_id", "device_id", "start_time", "end_time", "event_count", "total_duration", "conversion_value", F.substring(F.sha2(F.concat_ws(":", "account_id", "device_id", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss")), 256), 1, 16).alias("session_id"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and value by device type in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(w.alias("w"), "device_type").agg(F.count("*").alias("n"), F.sum("conversion_value").alias("value")).select(F.col("w.start").alias("start"), "device_type", "n", "value")


def write_sessions(sessions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once append of closed sessions to Parquet."""
    return sessions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def valid_and_quarantined(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the others, both streaming."""
    return split_valid(events)
