"""Driver tables as domain inputs: viewing events, journeys, vectors. Column pruning and filters reach the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsight.vocabulary import CHANNELS, DEVICE_TYPES, GENRES


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def viewing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, account_id, device_id, ts, event_type, device_type, genre, channel, duration_sec, conversion_value, k."""
    events = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("account_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 4).cast("string")).alias("device_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        pick(DEVICE_TYPES, k % 4).alias("device_type"),
        pick(GENRES, F.floor(k / 10).cast("int")).alias("genre"),
        pick(CHANNELS, k % 6).alias("channel"),
        F.col("value").alias("duration_sec"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("conversion_value"),
        "k",
    )


def journey_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person, position, channel, converted, value: one row per step of a person's journey."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    by_person = Window.partitionBy("o_custkey")
    ordered = by_person.orderBy("o_orderdate", "o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("person"),
        F.row_number().over(ordered).alias("position"),
        F.col("o_orderpriority").alias("channel"),
        (F.last("o_orderstatus").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "F").alias("converted"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).over(by_person).alias("value"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, features array<double>, true_person."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("session_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("true_person"))
