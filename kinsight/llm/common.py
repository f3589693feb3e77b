"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder that all executors see.

    The setting is read from the session. Where it is unset, a local session
    (tests, a laptop) uses a folder in its warehouse; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Lets a finished query's shuffle files go at once instead of when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a Python worker at a time: whole texts of any length.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write(df: DataFrame, path: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends here, and so do its shuffle files."""
    spark = df.sparkSession
    wanted = {CLEAN_UP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df by way of a table in the shared folder, which stays."""
    return write(df, shared_dir(df.sparkSession, what))


class Scratch:
    """Tables in the shared folder that go when the block ends, but for its results."""

    def __init__(self, spark: SparkSession, batch_rows: int | None = None):
        self.spark, self.paths, self.batch_rows = spark, {}, batch_rows

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, what: str) -> DataFrame:
        path = shared_dir(self.spark, what)
        out = write(df, path, self.batch_rows)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path, _ = self.paths.pop(id(df))
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def result(self, df: DataFrame, what: str) -> DataFrame:
        return written(df, what)

    def __exit__(self, *error) -> None:
        for _, df in list(self.paths.values()):
            self.drop(df)


def give_back() -> None:
    """Hand freed memory back to the system: idle Python workers stay beside Spark's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which hands its memory back when a task ends."""

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return spared


#: A key is heavy above this share of the rows, which bounds the number of heavy keys by its inverse.
HEAVY_SHARE = 1000


def join_spread(rows: DataFrame, found: DataFrame, key: str, value: str, count: str) -> DataFrame:
    """rows with the value found for their key, else null. found: key (unique), value, count (rows with the key).

    Heavy keys, of which there are fewer than HEAVY_SHARE, are joined by
    broadcast; the others by a shuffle in which a heavy key's rows are spread.
    """
    total = found.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_heavy = F.col(count) * HEAVY_SHARE > total
    heavy = found.where(is_heavy).select(key, F.col(value).alias("_often"))
    light = found.where(~is_heavy).select(F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s")).alias("_tail"), F.col(value).alias("_seldom"))
    joined = rows.join(F.broadcast(heavy), key, "left")
    tail = F.when(F.col("_often").isNull() & F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s"))).otherwise(F.struct(F.col(key).alias("k"), (F.xxhash64(*rows.columns) % 9973 + 10000).alias("s")))
    joined = joined.withColumn("_tail", tail).join(light, "_tail", "left")
    return joined.withColumn(value, F.coalesce("_often", "_seldom")).drop("_tail", "_often", "_seldom")
