"""Deletion by scope with cascades, retention, and a hash-chained audit log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
AUDITED = ("action", "actor", "event_type", "previous_hash", "resource", "seq", "ts")


def in_scope(events: DataFrame, account: str | None = None, devices: list[str] | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """Whether an event falls under a deletion request: of an account, of devices, within a time range."""
    held = F.lit(True)
    if account is not None:
        held = held & (F.col("account_id") == account)
    if devices is not None:
        held = held & F.col("device_id").isin(devices)
    if start is not None:
        held = held & (F.col("ts") >= start)
    if end is not None:
        held = held & (F.col("ts") <= end)
    return F.coalesce(held, F.lit(False))


def deletion(events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that stay, and those that go (to be backed up first). requests: account_id, device_id (null: all), from_ts, to_ts (null: open)."""
    r = requests.select(F.col("account_id").alias("_a"), F.col("device_id").alias("_d"), F.col("from_ts").alias("_f"), F.col("to_ts").alias("_t"))
    met = (F.col("account_id") == F.col("_a")) & (F.col("_d").isNull() | (F.col("device_id") == F.col("_d"))) & (F.col("_f").isNull() | (F.col("ts") >= F.col("_f"))) & (F.col("_t").isNull() | (F.col("ts") <= F.col("_t")))
    return events.join(r, met, "left_anti"), events.join(r, met, "left_semi")


def rebuilt_sessions(sessions: DataFrame, least: int = 2) -> DataFrame:
    """Sessions made anew from what stays; those with fewer events go."""
    return sessions.where(F.col("event_count") >= least)


def deletion_summary(gone: DataFrame) -> DataFrame:
    """account_id, events, devices, value deleted."""
    return gone.groupBy("account_id").agg(F.count("*").alias("events"), F.countDistinct("device_id").alias("devices"), F.sum("duration_sec").alias("duration"))


def retained(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def busy_actors(log: DataFrame, most: int = 100, seconds: int = 3600) -> DataFrame:
    """Log rows whose actor has more than `most` actions within the trailing hour."""
    trailing = Window.partitionBy("actor").orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    return log.withColumn("recent", F.count("*").over(trailing)).where(F.col("recent") > most)


def chain_hash(row: dict) -> str:
    return hashlib.sha256(json.dumps({k: row[k] for k in AUDITED}, sort_keys=True).encode()).hexdigest()


def chained(log: DataFrame, chain: str = "chain") -> DataFrame:
    """Adds previous_hash and event_hash along each chain in order of seq; one chain is one sequential writer's log.

    Rows stream through in order; a task holds one batch and the last hash.
    """
    fields = [f for f in log.columns if f not in ("previous_hash", "event_hash")]
    schema = log.select(*fields).schema.add("previous_hash", "string").add("event_hash", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, str] = {}
        for f in frames:
            before, after = [], []
            for row in f.to_dict("records"):
                previous = last.get(row[chain], GENESIS)
                row["previous_hash"] = previous
                last = {row[chain]: chain_hash(row)}
                before.append(previous)
                after.append(last[row[chain]])
            yield f.assign(previous_hash=before, event_hash=after)

    return log.select(*fields).repartition(chain).sortWithinPartitions(chain, "seq").mapInPandas(run, schema)


def broken_links(log: DataFrame, chain: str = "chain") -> DataFrame:
    """Rows whose previous_hash isn't the hash of the row before, or whose own hash doesn't match their fields."""
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(chain).orderBy("seq")), F.lit(GENESIS))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), r'(["\\])', r"\\$1"), F.lit('"'))
    text = F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{c}": '), F.col("seq").cast("string") if c == "seq" else quoted(c)) for c in AUDITED]), ", "), F.lit("}"))
    return log.withColumn("_before", before).where((F.col("_before") != F.col("previous_hash")) | (F.sha2(text, 256) != F.col("event_hash"))).drop("_before")
