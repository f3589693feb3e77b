"""Multi-touch attribution: absorbing Markov chain, removal effects, Shapley values, hybrid shares, touch rules.

A journey step table has person, position, channel, converted, value. The chain's
counts are a small table (channels squared); the channel number is guarded, and
the coalition table of 2^n rows is made and solved by built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, CONVERSION, NULL = "START", "CONVERSION", "NULL"
#: Coalitions double with each channel.
MOST_CHANNELS = 12


def transition_counts(steps: DataFrame, weight: Column | None = None) -> DataFrame:
    """source, target, n: bigrams of each journey with its start and its end, optionally weighted by step."""
    ordered = Window.partitionBy("person").orderBy("position")
    w = weight if weight is not None else F.lit(1.0)
    target = F.coalesce(F.lead("channel").over(ordered), F.when(F.col("converted"), CONVERSION).otherwise(NULL))
    inner = steps.select(F.col("channel").alias("source"), target.alias("target"), w.alias("n"))
    first = steps.where("position = 1").select(F.lit(START).alias("source"), F.col("channel").alias("target"), w.alias("n"))
    return inner.unionByName(first).groupBy("source", "target").agg(F.sum("n").alias("n"))


def transition_probabilities(counts: DataFrame) -> DataFrame:
    """Adds p, the count's share of its source."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def channels_of(counts: DataFrame) -> list[str]:
    """Sorted channels, at most MOST_CHANNELS."""
    found = sorted(r[0] for r in counts.select(F.col("source").alias("c")).where(F.col("c") != START).distinct().limit(MOST_CHANNELS + 1).collect())
    if len(found) > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels: use sampled Shapley values")
    return found


def matrices(probabilities: DataFrame, channels: list[str]) -> tuple[list[float], list[list[float]], list[float]]:
    """Start row, transitions among channels, and conversion column: at most (n + 1)(n + 2) numbers."""
    p = {(r.source, r.target): r.p for r in probabilities.collect()}
    return [p.get((START, c), 0.0) for c in channels], [[p.get((a, b), 0.0) for b in channels] for a in channels], [p.get((a, CONVERSION), 0.0) for a in channels]


def coalition_values(counts: DataFrame, iterations: int = 400) -> tuple[DataFrame, list[str]]:
    """mask, v: conversion probability if only the mask's channels exist; steps to others lose the journey. v(none) is 0.

    Each coalition's absorption is the fixed point of x = r + Qx over the channels it holds.
    """
    channels = channels_of(counts)
    start, q, r = matrices(transition_probabilities(counts), channels)
    n = len(channels)
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    has = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("mask").bitwiseAND(F.expr("1L").cast("long") * F.pow(F.lit(2.0), i).cast("long")) > 0)
    rows = F.array(*[array(row) for row in q])
    masks = counts.sparkSession.range(2**n).withColumnRenamed("id", "mask").withColumn("has", has)

    def step(x: Column, _: Column) -> Column:
        return F.transform(rows, lambda row, i: F.when(F.element_at(F.col("has"), i + 1), F.element_at(array(r), i + 1) + F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)).otherwise(0.0))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), array([0.0] * n), step)
    value = F.aggregate(F.zip_with(array(start), F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    return masks.withColumn("x", solved).select("mask", value.alias("v")), channels


def channel_table(values: DataFrame, channels: list[str]) -> DataFrame:
    return values.sparkSession.createDataFrame([(c, i, 1 << i) for i, c in enumerate(channels)], "channel string, number int, bit long")


def removal_effects(values: DataFrame, channels: list[str]) -> DataFrame:
    """channel, effect: the loss of conversion probability without the channel."""
    full = (1 << len(channels)) - 1
    whole = values.where(F.col("mask") == full).select(F.col("v").alias("all_v"))
    without = channel_table(values, channels).withColumn("mask", F.lit(full).cast("long") - F.col("bit")).join(values, "mask")
    return without.withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one").select("channel", (F.col("all_v") - F.col("v")).alias("effect"))


def shapley_values(values: DataFrame, channels: list[str]) -> DataFrame:
    """channel, shapley: exact, each coalition weighted by s!(n-s-1)!/n!."""
    n = len(channels)
    table = channel_table(values, channels)
    pairs = values.join(F.broadcast(table), F.col("mask").bitwiseAND(F.col("bit")) == 0)
    larger = values.select(F.col("mask").alias("larger"), F.col("v").alias("larger_v"))
    gained = pairs.withColumn("larger", F.col("mask") + F.col("bit")).join(larger, "larger")
    size = F.bit_count("mask")
    weight = F.factorial(size) * F.factorial(F.lit(n) - size - 1) / F.factorial(F.lit(n))
    return gained.groupBy("channel").agg(F.sum(weight * (F.col("larger_v") - F.col("v"))).alias("shapley"))


def normalised(rows: DataFrame, amount: str, share: str) -> DataFrame:
    """Adds the share of the total, or equal shares where the total is zero."""
    every = Window.partitionBy(F.lit(1))
    total = F.sum(amount).over(every)
    return rows.withColumn(share, F.when(F.abs(total) < 1e-12, 1 / F.count("*").over(every)).otherwise(F.col(amount) / total))


def hybrid(steps: DataFrame, alpha: float = 0.5) -> DataFrame:
    """channel, markov_share, shapley_share, share, value: alpha of the Markov share and the rest of the Shapley share."""
    values, channels = coalition_values(transition_counts(steps))
    markov = normalised(removal_effects(values, channels), "effect", "markov_share")
    shapley = normalised(shapley_values(values, channels), "shapley", "shapley_share")
    total = steps.where("position = 1 AND converted").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")).withColumn("one", F.lit(1))
    mixed = markov.join(shapley, "channel").withColumn("mixed", alpha * F.col("markov_share") + (1 - alpha) * F.col("shapley_share"))
    return normalised(mixed, "mixed", "share").withColumn("one", F.lit(1)).join(total, "one").select("channel", "markov_share", "shapley_share", "share", (F.col("share") * F.col("total")).alias("value"))


def state_visits(steps: DataFrame) -> pd.DataFrame:
    """Expected visits of each channel from the start: a row of the fundamental matrix, of at most MOST_CHANNELS states."""
    counts = transition_counts(steps)
    channels = channels_of(counts)
    start, q, _ = matrices(transition_probabilities(counts), channels)
    visits = np.array(start) @ np.linalg.inv(np.eye(len(channels)) - np.array(q))
    return pd.DataFrame({"channel": channels, "visits": visits})


def touch_credit(steps: DataFrame, decay: float = 0.8) -> DataFrame:
    """channel and the value credited to it by first, last, equal and decaying touches of converted journeys."""
    by_person = Window.partitionBy("person")
    n = F.count("*").over(by_person)
    credited = steps.where("converted").withColumns({"n": n, "back": n - F.col("position")})
    faded = F.pow(F.lit(decay), F.col("back"))
    credited = credited.withColumn("faded", faded / F.sum(faded).over(by_person))
    value = F.col("value")
    return credited.groupBy("channel").agg(
        F.sum(F.when(F.col("position") == 1, value).otherwise(0.0)).alias("first_touch"),
        F.sum(F.when(F.col("back") == 0, value).otherwise(0.0)).alias("last_touch"),
        F.sum(value / F.col("n")).alias("linear"),
        F.sum(value * F.col("faded")).alias("time_decay"),
    )


def sampled_shapley(values: DataFrame, channels: list[str], samples: int = 1000, batches: int = 10, seed: int = 42) -> DataFrame:
    """channel, shapley, error: marginal values over random orders, with the standard error over batches."""
    draws = values.sparkSession.range(samples).withColumnRenamed("id", "sample")
    keyed = F.transform(F.array(*[F.lit(1 << i) for i in range(len(channels))]), lambda b: F.struct(F.xxhash64(F.col("sample"), b, F.lit(seed)).alias("k"), b.cast("long").alias("b")))
    order = F.transform(F.array_sort(keyed), lambda s: s["b"])
    steps = draws.select("sample", F.posexplode(order).alias("i", "bit"))
    before = F.coalesce(F.sum("bit").over(Window.partitionBy("sample").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = F.broadcast(values) if len(channels) <= MOST_CHANNELS else values
    gained = steps.withColumn("mask", before).withColumn("larger", before + F.col("bit")).join(small, "mask").join(small.select(F.col("mask").alias("larger"), F.col("v").alias("larger_v")), "larger")
    by_batch = gained.groupBy((F.col("sample") % batches).alias("batch"), "bit").agg(F.avg(F.col("larger_v") - F.col("v")).alias("m"))
    return by_batch.groupBy("bit").agg(F.avg("m").alias("shapley"), (F.stddev_samp("m") / F.sqrt(F.lit(float(batches)))).alias("error")).join(F.broadcast(channel_table(values, channels)), "bit").select("channel", "shapley", "error")


def axioms(shapley: DataFrame, values: DataFrame, channels: list[str]) -> DataFrame:
    """One row: whether the values add up, whether equal players have equal values, whether dummies have none."""
    full = (1 << len(channels)) - 1
    v = {r.mask: r.v for r in values.collect()}
    s = {r.channel: r.shapley for r in shapley.collect()}
    masks = range(full + 1)
    gain = lambda i, m: v[m | 1 << i] - v[m]
    near = lambda a, b: abs(a - b) < 1e-9
    efficient = abs(sum(s.values()) - (v[full] - v[0])) < 1e-6
    symmetric = all(near(s[channels[i]], s[channels[j]]) for i in range(len(channels)) for j in range(i) if all(near(v[m | 1 << i], v[m | 1 << j]) for m in masks if not m & (1 << i | 1 << j)))
    dummy = all(near(s[c], 0) for i, c in enumerate(channels) if all(near(gain(i, m), 0) for m in masks if not m & 1 << i))
    return values.sparkSession.createDataFrame([(efficient, symmetric, dummy)], "efficiency boolean, symmetry boolean, dummy boolean")


def psychographic_weights(steps: DataFrame, weights: DataFrame) -> DataFrame:
    """Transition counts in which a step counts by its context's weight (1 if none). weights: channel, weight."""
    return transition_counts(steps.join(weights, "channel", "left"), F.coalesce("weight", F.lit(1.0)))
