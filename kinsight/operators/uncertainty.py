"""Uncertainty of attribution shares: sweeps, bootstrap, Dirichlet rows. Matrices here have a few states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsight.operators.attribution import CONVERSION, START, channels_of, transition_counts


def alpha_sweep(shares: DataFrame, steps: int = 20) -> DataFrame:
    """alpha, channel, share, rank for alpha from 0 to 1. shares: channel, markov_share, shapley_share."""
    swept = shares.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("alpha", F.col("i") / steps)
    mixed = F.col("alpha") * F.col("markov_share") + (1 - F.col("alpha")) * F.col("shapley_share")
    swept = swept.withColumn("share", mixed)
    return swept.withColumn("rank", F.rank().over(Window.partitionBy("i").orderBy(F.desc(F.round("share", 9))))).select("alpha", "channel", "share", "rank")


def sweep_summary(swept: DataFrame) -> DataFrame:
    """channel, range and relative range of its share, and the part of samples in which it holds rank 1, 2, 3."""
    at = lambda k: F.avg(F.when(F.col("rank") == k, 1.0).otherwise(0.0)).alias(f"rank_{k}")
    made = swept.groupBy("channel").agg(F.min("share").alias("low"), F.max("share").alias("high"), F.avg("share").alias("mean"), at(1), at(2), at(3))
    return made.withColumn("range", F.col("high") - F.col("low")).withColumn("relative_range", F.when(F.col("mean") > 0, F.col("range") / F.col("mean")).otherwise(0.0))


def removal_shares(p: dict[tuple[str, str], float], channels: list[str]) -> np.ndarray:
    """Normalised removal effects of a chain given as probabilities."""
    q = np.array([[p.get((a, b), 0.0) for b in channels] for a in channels])
    r, start = np.array([p.get((a, CONVERSION), 0.0) for a in channels]), np.array([p.get((START, c), 0.0) for c in channels])

    def value(held: np.ndarray) -> float:
        x = np.linalg.solve(np.eye(len(channels)) - q * held[:, None] * held[None, :], r * held)
        return float(start * held @ x)

    every = np.ones(len(channels))
    effects = np.array([value(every) - value(np.where(np.arange(len(channels)) == i, 0.0, 1.0)) for i in range(len(channels))])
    return effects / effects.sum() if abs(effects.sum()) > 1e-12 else np.full(len(channels), 1 / len(channels))


def solved(counts: DataFrame, key: str, channels: list[str]) -> DataFrame:
    """key, channel, share of each key's chain: one small group per sample."""

    def solve(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = f.groupby("source")["n"].transform("sum")
        p = {(s, t): v for s, t, v in zip(f["source"], f["target"], f["n"] / total) if v == v}
        return pd.DataFrame({key: k[0], "channel": channels, "share": removal_shares(p, channels)})

    return counts.groupBy(key).applyInPandas(solve, f"{key} long, channel string, share double")


def bootstrap(steps: DataFrame, samples: int = 100, seed: int = 42) -> DataFrame:
    """sample, channel, share: journeys drawn with Poisson(1) weights that a hash of person and sample fixes.

    Journeys are first reduced to counts per sample, so the groups solved are a few dozen rows each.
    """
    ordered = Window.partitionBy("person").orderBy("position")
    target = F.coalesce(F.lead("channel").over(ordered), F.when(F.col("converted"), "CONVERSION").otherwise("NULL"))
    grams = steps.select("person", F.col("channel").alias("source"), target.alias("target")).unionByName(steps.where("position = 1").select("person", F.lit(START).alias("source"), F.col("channel").alias("target")))
    drawn = grams.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    u = F.pmod(F.xxhash64("person", "sample", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    levels, total, term = [], 0.0, float(np.exp(-1))
    for k in range(8):
        total += term
        levels.append(F.when(u >= total, 1.0).otherwise(0.0))
        term /= k + 1
    counts = drawn.groupBy("sample", "source", "target").agg(F.sum(sum(levels[1:], levels[0])).alias("n")).where("n > 0")
    return solved(counts, "sample", channels_of(transition_counts(steps)))


def dirichlet(steps: DataFrame, samples: int = 100, prior: float = 0.1, seed: int = 42) -> DataFrame:
    """sample, channel, share: transition rows drawn from Dirichlet(prior + real counts)."""
    counts = transition_counts(steps)
    channels = channels_of(counts)
    spread = counts.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        r = np.random.default_rng([seed, int(key[0])])
        f = f.sort_values(["source", "target"])
        f["g"] = r.gamma(f["n"].to_numpy() + prior)
        p = {(s, t): v for s, t, v in zip(f["source"], f["target"], f["g"] / f.groupby("source")["g"].transform("sum"))}
        return pd.DataFrame({"sample": key[0], "channel": channels, "share": removal_shares(p, channels)})

    return spread.groupBy("sample").applyInPandas(solve, "sample long, channel string, share double")


def intervals(samples: DataFrame, level: float = 0.9) -> DataFrame:
    """channel, low, median, high of its share at the given level."""
    tail = (1 - level) / 2
    q = lambda x: F.expr(f"percentile(share, {x})")
    return samples.groupBy("channel").agg(q(tail).alias("low"), q(0.5).alias("median"), q(1 - tail).alias("high"), F.count("*").alias("n"))


def wider_source(boot: DataFrame, dirich: DataFrame) -> DataFrame:
    """channel and which source of uncertainty has the wider interval."""
    width = lambda df, n: intervals(df).select("channel", (F.col("high") - F.col("low")).alias(n))
    return width(boot, "path_width").join(width(dirich, "transition_width"), "channel").withColumn("dominant", F.when(F.col("path_width") >= F.col("transition_width"), "path_variation").otherwise("transition_estimates"))


def lambda_sweep(counts: DataFrame, strengths: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0)) -> DataFrame:
    """strength, channel, share of touches weighted by 1 + strength * (weight - 1). counts: channel, n, weight: a row per channel."""
    swept = counts.withColumn("strength", F.explode(F.array(*[F.lit(x) for x in strengths])))
    made = swept.withColumn("amount", F.col("n") * (1 + F.col("strength") * (F.col("weight") - 1)))
    return made.withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy("strength"))).select("strength", "channel", "share")
