"""Drift signals between a baseline and a current period, snapshots and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composition(baseline: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """key, n_new, n_removed, chi_square, kind, severity from the shares of values in both periods."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(key, value).agg(F.count("*").alias("c"))
        return counts.select(key, value, (F.col("c") / F.sum("c").over(Window.partitionBy(key))).alias(name))

    joined = shares(baseline, "b").join(shares(current, "c"), [key, value], "full")
    made = joined.groupBy(key).agg(
        F.count(F.when(F.col("b").isNull(), 1)).alias("n_new"), F.count(F.when(F.col("c").isNull(), 1)).alias("n_removed"),
        F.coalesce(F.sum(F.when(F.col("b") > 0, F.pow(F.coalesce("c", F.lit(0.0)) - F.col("b"), 2) / F.col("b"))), F.lit(0.0)).alias("chi_square"),
    )
    kind = F.when(F.col("n_new") > 0, "COMPOSITION_NEW").when(F.col("n_removed") > 0, "COMPOSITION_REMOVED").when(F.col("chi_square") > 0.5, "BEHAVIORAL").otherwise("NONE")
    severity = F.when(F.col("n_new") > 0, 0.7).when(F.col("n_removed") > 0, 0.5).when(F.col("chi_square") > 0.5, F.least(F.col("chi_square"), F.lit(1.0))).otherwise(0.0)
    return made.withColumns({"kind": kind, "severity": severity})


def top_hours(sessions: DataFrame, key: str, k: int = 3) -> DataFrame:
    counts = sessions.groupBy(key, "hour_of_day").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "hour_of_day"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "hour_of_day")


def peak_shift(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, shift (mean circular hours from each current peak to the baseline peak nearest on the line), severity."""
    b = top_hours(baseline, key).groupBy(key).agg(F.array_sort(F.collect_list("hour_of_day")).alias("base"))
    nearest = F.array_min(F.transform("base", lambda h: F.struct(F.abs(h - F.col("hour_of_day")).alias("d"), h.alias("h"))))["d"]
    joined = top_hours(current, key).join(b, key).withColumn("d", nearest)
    made = joined.groupBy(key).agg(F.avg(F.least(F.col("d"), 24 - F.col("d"))).alias("shift"))
    return made.withColumn("severity", F.when(F.col("shift") > 3, F.least(F.col("shift") / 6, F.lit(1.0))).otherwise(0.0))


def volume(baseline: DataFrame, current: DataFrame, key: str, base_days: float, days: float) -> DataFrame:
    """key, ratio of current to expected sessions, missing below one half."""
    b, c = baseline.groupBy(key).agg(F.count("*").alias("nb")), current.groupBy(key).agg(F.count("*").alias("nc"))
    ratio = F.coalesce("nc", F.lit(0)) / (F.col("nb") * days / base_days)
    return b.join(c, key, "left").withColumn("ratio", ratio).withColumn("missing", F.col("ratio") < 0.5).select(key, "ratio", "missing")


def weekend_change(baseline: DataFrame, current: DataFrame, key: str, month: Column) -> DataFrame:
    """key, change of the weekend share, kind: SEASONAL in months 1, 3, 6, 7, 8, 12, else BEHAVIORAL, above 0.15."""
    ratio = lambda df, n: df.groupBy(key).agg(F.avg((F.col("day_of_week") >= 5).cast("double")).alias(n))
    made = ratio(baseline, "b").join(ratio(current, "c"), key).withColumn("change", F.abs(F.col("c") - F.col("b")))
    return made.withColumn("kind", F.when(F.col("change") <= 0.15, "NONE").when(month.isin(1, 3, 6, 7, 8, 12), "SEASONAL").otherwise("BEHAVIORAL")).select(key, "change", "kind")


def distance_drift(rows: DataFrame, key: str, value: str, order: str, recent: int = 50) -> DataFrame:
    """key, z of the last `recent` values' mean against the earlier values, drifted above 2, kind by the last tens."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    ranked = rows.withColumn("nth", nth)
    mean = lambda lo, hi: F.avg(F.when(F.col("nth").between(lo, hi), F.col(value)))
    made = ranked.groupBy(key).agg(mean(1, recent).alias("now"), F.avg(F.when(F.col("nth") > recent, F.col(value))).alias("base"), F.stddev_pop(F.when(F.col("nth") > recent, F.col(value))).alias("spread"), mean(1, 10).alias("ten"), mean(11, 20).alias("ten_before"))
    made = made.withColumn("z", F.when(F.col("spread") > 0, F.abs(F.col("now") - F.col("base")) / F.col("spread")))
    kind = F.when(~(F.col("z") > 2), "none").when(F.col("ten") > 1.2 * F.col("ten_before"), "gradual_expansion").when(F.col("ten") < 0.8 * F.col("ten_before"), "gradual_contraction").when(F.col("z") > 3, "sudden_shift").otherwise("general")
    return made.withColumns({"drifted": F.coalesce(F.col("z") > 2, F.lit(False)), "kind": F.coalesce(kind, F.lit("none"))}).select(key, "z", "drifted", "kind")


def strongest(signals: DataFrame, key: str) -> DataFrame:
    """key, signal, severity of the severest signal (ties to the first by name), and whether to cluster anew."""
    made = signals.where("severity > 0").groupBy(key).agg(F.min_by(F.struct("signal", "severity"), F.struct(-F.col("severity"), F.col("signal"))).alias("s")).select(key, "s.signal", "s.severity")
    return made.withColumn("recluster", (F.col("severity") >= 0.7) | F.col("signal").startswith("COMPOSITION"))


def newest_snapshots(snapshots: DataFrame, key: str, version: str, keep: int = 5) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return snapshots.withColumn("_nth", nth).where(F.col("_nth") <= keep).drop("_nth")


def should_roll_back(metrics: DataFrame) -> DataFrame:
    """Adds roll_back: Brier worse by 0.15 or accuracy by 0.1. metrics: brier, base_brier, accuracy, base_accuracy."""
    return metrics.withColumn("roll_back", (F.round(F.col("brier") - F.col("base_brier"), 9) > 0.15) | (F.round(F.col("base_accuracy") - F.col("accuracy"), 9) > 0.1))


def baselines(sessions: DataFrame, key: str, least: int = 50) -> DataFrame:
    """key, n, weekend share, mean hour and duration of groups with enough sessions."""
    made = sessions.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col("day_of_week") >= 5).cast("double")).alias("weekend"), F.avg("hour_of_day").alias("mean_hour"), F.avg("total_duration").alias("mean_duration"))
    return made.where(F.col("n") >= least)


def confidence_drop(baseline: DataFrame, current: DataFrame, key: str, value: str, least: float = 0.2) -> DataFrame:
    """key, drop of the mean confidence, and severity above `least`."""
    mean = lambda df, n: df.groupBy(key).agg(F.avg(value).alias(n))
    made = mean(baseline, "b").join(mean(current, "c"), key).withColumn("drop", F.col("b") - F.col("c"))
    return made.select(key, "drop", F.when(F.col("drop") > least, F.least(F.col("drop") * 2, F.lit(1.0))).otherwise(0.0).alias("severity"))


def quick_shift(baseline: DataFrame, current: DataFrame, key: str, least: int = 10, hours: float = 3.0) -> DataFrame:
    """key, circular difference of the mean hours, whether it exceeds `hours`; groups with enough sessions on both sides."""
    mean = lambda df, n: df.groupBy(key).agg(F.avg("hour_of_day").alias(n), F.count("*").alias(f"n_{n}")).where(F.col(f"n_{n}") >= least)
    apart = F.abs(F.col("c") - F.col("b"))
    return mean(baseline, "b").join(mean(current, "c"), key).withColumn("shift", F.least(apart, 24 - apart)).select(key, "shift", (F.col("shift") > hours).alias("shifted"))


def holdout(rows: DataFrame, key: str, order: list[str], keep: int = 100) -> DataFrame:
    """The newest `keep` rows of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= keep).drop("_nth")


def regime_metrics(assigned: DataFrame, key: str, predicted: str, truth: str, distance: str, least: int = 20) -> DataFrame:
    """key, n, accuracy, confidence (1 / (1 + distance)) and Brier of a new clustering on held-out rows."""
    sure, right = 1 / (1 + F.col(distance)), (F.col(predicted) == F.col(truth)).cast("double")
    made = assigned.groupBy(key).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(sure).alias("confidence"), F.avg(F.pow(sure - right, 2)).alias("brier"))
    return made.where(F.col("n") >= least)
