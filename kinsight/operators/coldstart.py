"""Assignments for accounts with few sessions: strategy, population priors, heuristics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.vocabulary import PERSONA_PRIORS


def strategy(n: Column, enough: int = 10) -> Column:
    return F.when(n >= enough, "ready_for_clustering").when(n < 3, "account_level").when(n < 7, "probabilistic_prior").otherwise("heuristic")


def persona_scores(hour: Column, device: Column, genres: Column) -> dict[str, Column]:
    """Unnormalised score by persona: prior, doubled at peak hours, times 1.5 each for its devices and genres."""
    return {
        persona: F.lit(prior) * F.when(hour.isin(hours), 2.0).otherwise(1.0) * F.when(device.isin(devices), 1.5).otherwise(1.0) * F.when(F.arrays_overlap(genres, F.array(*[F.lit(g) for g in liked])), 1.5).otherwise(1.0)
        for persona, (prior, hours, liked, devices) in PERSONA_PRIORS.items()
    }


def prior_assignment(rows: DataFrame) -> DataFrame:
    """Adds persona and confidence to rows with hour, device, genres of an account's last session; ties to the first persona."""
    scores = persona_scores(F.coalesce("hour", F.lit(20)), F.coalesce("device", F.lit("tv")), F.coalesce("genres", F.array().cast("array<string>")))
    total = reduce(Column.__add__, scores.values())
    best = F.array_max(F.array(*[F.struct((s / total).alias("p"), F.lit(-i).alias("i"), F.lit(p).alias("persona")) for i, (p, s) in enumerate(scores.items())]))
    return rows.withColumn("_best", best).withColumns({"persona": F.col("_best.persona"), "confidence": F.col("_best.p")}).drop("_best")


def heuristic_persona(hour: Column, device: Column, genre: Column) -> Column:
    late = hour.isin(21, 22, 23, 0, 1)
    return (
        F.when(hour.between(10, 17) & genre.isin("Kids", "Animation", "Family"), "child")
        .when(late & (device.isin("mobile", "tablet") | genre.isin("Action", "SciFi", "Fantasy")), "teen")
        .when((device == "tv") & hour.between(19, 23), "primary_adult")
        .when(genre.isin("Documentary", "News", "Classics"), "secondary_adult")
        .otherwise("primary_adult")
    )


def heuristic_assignment(sessions: DataFrame, genres: DataFrame, key: str) -> DataFrame:
    """key, persona, confidence from the modes of hour, device and genre; fewer different hours, more confidence."""
    made = sessions.groupBy(key).agg(F.mode("hour_of_day", deterministic=True).alias("hour"), F.mode("device_type", deterministic=True).alias("device"), (0.5 + (1 - F.countDistinct("hour_of_day") / F.count("*")) * 0.3).alias("confidence"))
    liked = genres.groupBy(key).agg(F.mode("genre", deterministic=True).alias("genre"))
    return made.join(liked, key, "left").withColumn("persona", heuristic_persona(F.col("hour"), F.col("device"), F.coalesce("genre", F.lit("Drama"))))


def progress(n: Column, enough: int = 10) -> tuple[Column, Column]:
    """Sessions still needed, and days at two sessions a day."""
    left = F.greatest(enough - n, F.lit(0))
    return left, left / 2
