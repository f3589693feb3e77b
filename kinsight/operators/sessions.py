"""Gap sessionization and session aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_time(ts: Column) -> Column:
    """A timestamp as text; the fraction appears only if there is one."""
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))))


def with_session_number(events: DataFrame, gap_minutes: int = 30, keys: tuple[str, ...] = ("account_id", "device_id")) -> DataFrame:
    """Adds session_no: a new session starts when the gap to the event before exceeds gap_minutes (an equal gap continues)."""
    ordered = Window.partitionBy(*keys).orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(ordered))
    starts = F.when(gap.isNull() | (gap > gap_minutes * 60_000_000), 1).otherwise(0)
    return events.withColumn("_starts", starts).withColumn("session_no", F.sum("_starts").over(ordered)).drop("_starts")


def session_key(keys: tuple[str, ...]) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *keys, plain_time(F.col("start_time")))), 1, 16)


def sessions(events: DataFrame, gap_minutes: int = 30, keys: tuple[str, ...] = ("account_id", "device_id")) -> DataFrame:
    """One row per session. A conversion is an event with a positive conversion value. One shuffle, by the keys."""
    first = F.struct("ts", "event_id")
    numbered = with_session_number(events, gap_minutes, keys)
    made = numbered.groupBy(*keys, "session_no").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").alias("event_count"),
        F.sum("duration_sec").alias("total_duration"),
        F.min_by("device_type", first).alias("device_type"),
        F.min_by("channel", first).alias("first_channel"),
        F.sum(F.when(F.col("conversion_value") > 0, F.col("conversion_value")).otherwise(0.0)).alias("conversion_value"),
        F.countDistinct("channel").alias("n_channels"),
    )
    return made.withColumn("session_id", session_key(keys)).withColumn("hour_of_day", F.hour("start_time")).withColumn("day_of_week", F.weekday("start_time"))


def session_genres(events: DataFrame, gap_minutes: int = 30, keys: tuple[str, ...] = ("account_id", "device_id")) -> DataFrame:
    """keys, session_no, genre, seconds: time by genre in each session."""
    return with_session_number(events, gap_minutes, keys).groupBy(*keys, "session_no", "genre").agg(F.sum("duration_sec").alias("seconds"))


def with_primary_genre(made: DataFrame, genres: DataFrame, keys: tuple[str, ...] = ("account_id", "device_id")) -> DataFrame:
    """Adds primary_genre: the genre with most time, ties to the first by name."""
    ranked = genres.groupBy(*keys, "session_no").agg(F.min_by("genre", F.struct(-F.col("seconds"), F.col("genre"))).alias("primary_genre"))
    return made.join(ranked, [*keys, "session_no"], "left")


def window_sessions(events: DataFrame, gap_minutes: int = 30, keys: tuple[str, ...] = ("account_id", "device_id")) -> DataFrame:
    """The same sessions by Spark's session window."""
    return events.groupBy(*keys, F.session_window("ts", f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("event_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.sum("duration_sec").alias("total_duration")).drop("w")
