"""Live sessions equal batch sessions once closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsight.operators.sessions import sessions
from kinsight.sources import files
from kinsight.sources.views import viewing_events
from kinsight.streaming.sessions import live_sessions, tumbling_counts, write_sessions


def test_live_sessions(spark, tmp_path):
    events = viewing_events(spark, "/root/testdata/sf0.001").withColumn("event_id", F.col("event_id").cast("string")).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    files.write(events.select("event_id", "account_id", "device_id", "ts", "event_type", "device_type", "genre", "channel", "duration_sec", "conversion_value", "metadata"), str(tmp_path / "in"), "parquet")
    live = live_sessions(files.stream_events(spark, str(tmp_path / "in"), "parquet"))
    for _ in range(2):
        write_sessions(live, str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination()
    got = {(r.device_id, r.start_time): r.event_count for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.device_id, r.start_time): r.event_count for r in sessions(events, 30).collect()}
    assert len(got) > 0.9 * len(want) and got.items() <= want.items()
    assert tumbling_counts(files.stream_events(spark, str(tmp_path / "in"), "parquet")).isStreaming


def test_json_round_trip(spark, tmp_path):
    events = viewing_events(spark, "/root/testdata/sf0.001").limit(5).drop("k").withColumn("event_id", F.col("event_id").cast("string"))
    assert files.decoded(files.encoded(events), "json").count() == 5
    files.write(events, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
