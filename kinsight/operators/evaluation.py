"""Calibration, accuracy, fairness and feedback metrics, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reliability(rows: DataFrame, p: str = "p", y: str = "y", digits: int = 1) -> DataFrame:
    """bin (probability rounded half to even), n, mean_p, rate."""
    return rows.groupBy(F.bround(p, digits).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row: n, brier, skill against the base rate, weighted ece, mce, grade."""
    sums = rows.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("base")).withColumn("one", F.lit(1))
    gaps = reliability(rows, p, y).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))
    errors = gaps.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce")).withColumn("one", F.lit(1))
    reference = F.col("base") * (1 - F.col("base"))
    made = sums.join(errors, "one").withColumn("skill", F.when(reference > 0, 1 - F.col("brier") / reference).otherwise(0.0))
    return made.withColumn("grade", F.when(F.col("skill") > 0.7, "excellent").when(F.col("skill") > 0.5, "good").when(F.col("skill") > 0.2, "fair").otherwise("poor")).drop("one", "base")


def temperature_scaled(rows: DataFrame, p: str = "p") -> DataFrame:
    """Adds calibrated: the logit (within 10) divided by mean probability / 0.5, taken over all rows."""
    mean = rows.agg(F.avg(p).alias("mean")).withColumn("one", F.lit(1))
    logit = F.when(F.col(p) <= 0, -10.0).when(F.col(p) >= 1, 10.0).otherwise(F.log(F.col(p) / (1 - F.col(p))))
    heat = F.when(F.col("mean") > 0, F.col("mean") / 0.5).otherwise(1.0)
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(mean), "one").withColumn("calibrated", 1 / (1 + F.exp(-logit / heat))).drop("one", "mean")


def accuracy_by(rows: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """keys, n, accuracy, mean_p, brier and |accuracy - mean_p| of groups with enough rows. rows: p, y."""
    made = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("accuracy"), F.avg("p").alias("mean_p"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return made.where(F.col("n") >= least).withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_p")))


def actions(metrics: DataFrame) -> DataFrame:
    """Adds action by accuracy: critical below 0.6, warning below 0.7, else none."""
    return metrics.withColumn("action", F.when(F.col("accuracy") < 0.6, "critical").when(F.col("accuracy") < 0.7, "warning").otherwise("none"))


def trend(windows: DataFrame, order: str, value: str, within: float = 0.02) -> DataFrame:
    """Adds trend against the value two windows before."""
    before = F.lag(value, 2).over(Window.orderBy(order))
    return windows.withColumn("trend", F.when(before.isNull(), "unknown").when(F.col(value) > before + within, "improving").when(F.col(value) < before - within, "degrading").otherwise("stable"))


def classification(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1."""
    p = rows.groupBy(F.col(predicted).alias("class")).agg(F.count("*").alias("n_predicted"), F.count(F.when(F.col(predicted) == F.col(truth), 1)).alias("tp"))
    t = rows.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("n_true"))
    made = p.join(t, "class", "full").fillna(0)
    precision = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    recall = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    made = made.withColumns({"fp": F.col("n_predicted") - F.col("tp"), "fn": F.col("n_true") - F.col("tp"), "precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    return made.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).select("class", "tp", "fp", "fn", "precision", "recall", "f1")


def link_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of unordered pairs a, b. Two empty sets agree."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p, t = pair(predicted).withColumn("p", F.lit(1)), pair(truth).withColumn("t", F.lit(1))
    sums = p.join(t, ["a", "b"], "full").agg(F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).when(F.col("fp") + F.col("fn") == 0, 1.0).otherwise(0.0)
    made = sums.withColumns({"precision": share("fp"), "recall": share("fn")})
    both = F.col("precision") + F.col("recall")
    return made.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def size_error(rows: DataFrame) -> DataFrame:
    """One row: mean absolute error and exact share of rows (size, true_size)."""
    return rows.agg(F.avg(F.abs(F.col("size") - F.col("true_size"))).alias("mae"), F.avg((F.col("size") == F.col("true_size")).cast("double")).alias("exact"))


def overall_score(size: Column, assignment: Column, link: Column, calibrated: Column) -> Column:
    return 0.15 * size + 0.35 * assignment + 0.25 * link + 0.25 * calibrated


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for the error function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # The approximation's coefficients.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def two_proportions(rows: DataFrame) -> DataFrame:
    """Adds z and p_value (two-sided) to rows with x1, n1, x2, n2."""
    pooled = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    made = rows.withColumn("z", F.when(error > 0, (F.col("x1") / F.col("n1") - F.col("x2") / F.col("n2")) / error).otherwise(0.0))
    return made.withColumn("p_value", 2 * (1 - normal_cdf(F.abs("z"))))


def disparate_impact(rows: DataFrame, group: str, rate: str) -> DataFrame:
    """group, n, rate and the smallest rate over the largest."""
    made = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(rate).alias("rate"))
    every = Window.partitionBy(F.lit(1))
    return made.withColumn("impact", F.when(F.max("rate").over(every) > 0, F.min("rate").over(every) / F.max("rate").over(every)).otherwise(1.0))


def implicit_feedback(predictions: DataFrame, sessions: DataFrame, hours: int = 24, least: int = 3) -> DataFrame:
    """Ids of predictions (id, account_id, at) confirmed by at least `least` later sessions, all on one device."""
    later = predictions.join(sessions.select("account_id", "device_id", "start_time"), "account_id").where(F.unix_micros("start_time") - F.unix_micros("at") >= hours * 3_600_000_000)
    return later.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("device_id").alias("devices")).where((F.col("n") >= least) & (F.col("devices") == 1)).select("id")


def resolved(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Predictions that have feedback, with `correct`. predictions: id, predicted; feedback: id, actual, kind."""
    return predictions.join(feedback, "id").withColumn("correct", F.col("predicted") == F.col("actual"))


def kept_predictions(predictions: DataFrame, at: str, now: Column, days: int = 7) -> DataFrame:
    """Predictions no older than `days`."""
    return predictions.where(F.unix_micros(at) >= F.unix_micros(now) - days * 86_400_000_000)


def test_results(rows: DataFrame, test: str, kind: str) -> DataFrame:
    """test, kind, n, n_correct, accuracy, confidence of resolved predictions within each test."""
    return rows.groupBy(test, kind).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("p").alias("confidence"))


def decile_report(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """bin (probability cut to tenths), n, accuracy, error."""
    made = rows.groupBy((F.floor(F.col(p) * 10) / 10).alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("accuracy"))
    return made.withColumn("error", F.abs(F.col("bin") - F.col("accuracy")))


def calibration_score(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row: score (1 - mean error of the bins, each counted alike, within 0 and 1) and mae; 0.5 and 0.5 without rows."""
    bins = rows.groupBy(F.bround(p, 1).alias("bin")).agg(F.avg(y).alias("rate")).agg(F.avg(F.abs(F.col("bin") - F.col("rate"))).alias("error")).withColumn("one", F.lit(1))
    mae = rows.agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae")).withColumn("one", F.lit(1))
    score = F.least(F.greatest(1 - F.col("error"), F.lit(0.0)), F.lit(1.0))
    return bins.join(mae, "one").select(F.coalesce(score, F.lit(0.5)).alias("score"), F.coalesce("mae", F.lit(0.5)).alias("mae"))


def lift(rows: DataFrame, model: str, baseline: str, truth: str) -> DataFrame:
    """One row: accuracy of model and baseline against the truth, and the relative lift."""
    of = lambda c: F.avg((F.col(c) == F.col(truth)).cast("double"))
    made = rows.agg(of(model).alias("model_accuracy"), of(baseline).alias("baseline_accuracy"))
    return made.withColumn("lift", F.when(F.col("baseline_accuracy") > 0, F.col("model_accuracy") / F.col("baseline_accuracy") - 1).otherwise(0.0))
