"""Sources and sinks: JSON events, CSV and Parquet tables, graph and model snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id string, account_id string, device_id string, ts timestamp, event_type string, device_type string, genre string, channel string, duration_sec double, conversion_value double, metadata map<string,string>"


def read_events(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Events with the given schema; unknown fields are dropped."""
    return spark.read.schema(EVENT_SCHEMA).format(kind).load(path)


def stream_events(spark: SparkSession, path: str, kind: str = "json", files: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).format(kind).option("maxFilesPerTrigger", files).load(path)


def decoded(rows: DataFrame, column: str) -> DataFrame:
    """Events from a JSON text column."""
    return rows.select(F.from_json(column, EVENT_SCHEMA).alias("e")).select("e.*")


def encoded(rows: DataFrame) -> DataFrame:
    """One JSON text per row, keys in the order of the columns."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def write(rows: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def nested(parents: DataFrame, children: DataFrame, key: str, name: str = "members") -> DataFrame:
    """parents with an array of their children's rows: household with members, entity with its edges."""
    fields = [c for c in children.columns if c != key]
    held = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))


def decoded_as(rows: DataFrame, column: str, schema) -> DataFrame:
    """Rows of a schema from a JSON text column, the counterpart of `encoded`."""
    return rows.select(F.from_json(column, schema).alias("e")).select("e.*")


def write_json_events(rows: DataFrame, path: str) -> None:
    """Attribution events, one JSON object per line, with times as ISO text."""
    write(encoded(rows).withColumnRenamed("json", "value"), path, kind="text")


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes and edges, and of each type, as the graph's metadata in JSON. The tables themselves stay distributed."""
    counts = lambda df, name: df.groupBy("type").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias(f"{name}_types")).withColumn("one", F.lit(1))
    return counts(nodes, "node").join(counts(edges, "edge"), "one").select(F.to_json(F.struct("node_count", "edge_count", "node_types", "edge_types")).alias("metadata"))


def read_snapshots(spark: SparkSession, path: str, newest: int = 5) -> DataFrame:
    """The newest versions of the models; older ones' folders are not read."""
    models = spark.read.parquet(path)
    versions = [r.version for r in models.select("version").distinct().orderBy(F.desc("version")).limit(newest).collect()]
    return models.where(F.col("version").isin(versions))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write(nodes, f"{path}/nodes")
    write(edges, f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_snapshot(models: DataFrame, path: str, version: int) -> None:
    """Models of a version, appended; centroids stay arrays."""
    write(models.withColumn("version", F.lit(version)), path, partition_by=["version"], mode="append")
