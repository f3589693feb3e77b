"""Feature expressions: events, sessions for clustering, devices. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.vocabulary import DEVICE_TYPES, GENRES

#: Names of the clustering features, in order.
CLUSTER_FEATURES = ["hour_sin", "hour_cos", "day_sin", "day_cos", "is_weekend", *[f"device_{d}" for d in DEVICE_TYPES], *[f"genre_{g.lower()}" for g in GENRES], "duration_log", "event_density"]


def cyclic(value: Column, period: int, name: str) -> list[Column]:
    angle = value * (2 * math.pi / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def one_hot(value: Column, values: list[str], prefix: str) -> list[Column]:
    return [F.when(value == v, 1.0).otherwise(0.0).alias(f"{prefix}_{v.lower()}") for v in values]


def event_features(events: DataFrame) -> DataFrame:
    """event_id, cyclic hour and day, log duration, device one-hot (with unknown)."""
    known = F.when(F.col("device_type").isin(*DEVICE_TYPES), F.col("device_type")).otherwise("unknown")
    return events.select("event_id", *cyclic(F.hour("ts"), 24, "hour"), *cyclic(F.weekday("ts"), 7, "day"), F.log1p("duration_sec").alias("duration_log"), *one_hot(known, [*DEVICE_TYPES, "unknown"], "device"))


def cluster_features(sessions: DataFrame, genres: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 21 clustering features of each session."""
    shares = genres.groupBy(*keys).pivot("genre", GENRES).agg(F.sum("seconds"))
    total = F.col("total_duration")
    minutes = total / 60
    share = [F.when(total > 0, F.coalesce(F.col(g), F.lit(0.0)) / total).otherwise(0.0).alias(f"genre_{g.lower()}") for g in GENRES]
    return sessions.join(shares, keys, "left").select(
        *keys, "session_id",
        *cyclic(F.col("hour_of_day"), 24, "hour"), *cyclic(F.col("day_of_week"), 7, "day"),
        F.when(F.col("day_of_week") >= 5, 1.0).otherwise(0.0).alias("is_weekend"),
        *one_hot(F.col("device_type"), DEVICE_TYPES, "device"), *share,
        F.log1p(minutes).alias("duration_log"),
        F.when(total > 0, F.col("event_count") / minutes).otherwise(0.0).alias("event_density"),
    )


def weight(name: str) -> float:
    """Time features weigh 1.5, devices 1.2, all others 1."""
    return 1.5 if name.startswith(("hour_", "day_")) else 1.2 if name.startswith("device_") else 1.0


def normalised(features: DataFrame, group: str, names: list[str] = CLUSTER_FEATURES) -> DataFrame:
    """Population z-scores within each group (a zero deviation counts as one), then weighted."""
    within = Window.partitionBy(group)
    scored = []
    for n in names:
        deviation = F.stddev_pop(n).over(within)
        scored.append(((F.col(n) - F.avg(n).over(within)) / F.when(deviation == 0, 1.0).otherwise(deviation) * weight(n)).alias(n))
    return features.select(*[c for c in features.columns if c not in names], *scored)


def device_fingerprint(*parts: Column) -> Column:
    """First 16 characters of the hash of lower-cased parts joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(p) for p in parts]), 256), 1, 16)
