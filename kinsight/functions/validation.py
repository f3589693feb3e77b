"""Row validation as columns: errors and warnings are arrays of codes; a row is valid without errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.vocabulary import DEVICE_TYPES, EVENT_TYPES


def codes(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))


def missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def validate_events(events: DataFrame, required: tuple[str, ...] = ("event_id", "account_id", "device_id", "ts", "event_type", "genre"), most_id: int = 256, most_device: int = 128) -> DataFrame:
    """Adds errors and warnings. Required fields, negative durations, id lengths, markup in account ids; unknown types, odd years, long durations."""
    errors = codes(
        *[(missing(n), f"missing_{n}") for n in required],
        (F.col("duration_sec") < 0, "negative_duration"),
        (F.length(F.col("event_id").cast("string")) > most_id, "event_id_length"),
        (F.length("account_id") > most_device, "account_id_length"),
        (F.col("account_id").rlike("[<>\"'&]"), "account_id_characters"),
    )
    warnings = codes(
        (~F.col("event_type").isin(EVENT_TYPES), "unknown_event_type"),
        (~F.col("device_type").isin([*DEVICE_TYPES, "unknown"]), "unknown_device_type"),
        (~F.year("ts").between(2020, 2030), "odd_year"),
        (F.col("duration_sec") > 86400, "long_duration"),
    )
    return events.withColumns({"errors": errors, "warnings": warnings})


def validate_batch(events: DataFrame) -> DataFrame:
    """One row: n_rows, n_invalid, n_warned, n_duplicates, is_valid. An empty batch is invalid."""
    checked = validate_events(events)
    sums = checked.agg(F.count("*").alias("n_rows"), F.count(F.when(F.size("errors") > 0, 1)).alias("n_invalid"), F.count(F.when(F.size("warnings") > 0, 1)).alias("n_warned"), (F.count("event_id") - F.countDistinct("event_id")).alias("n_duplicates"))
    return sums.withColumn("is_valid", (F.col("n_rows") > 0) & (F.col("n_invalid") == 0))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and all others for quarantine."""
    checked = validate_events(events)
    return checked.where(F.size("errors") == 0).drop("errors", "warnings"), checked.where(F.size("errors") > 0)


def validate_sessions(sessions: DataFrame, probabilities: str | None = None) -> DataFrame:
    """Adds errors and warnings to sessions (start_time, end_time, event_count, total_duration)."""
    checks = [
        (missing("session_id"), "missing_session_id"), (missing("account_id"), "missing_account_id"),
        (F.col("end_time") < F.col("start_time"), "ends_before_start"), (F.col("event_count") < 0, "negative_event_count"),
    ]
    if probabilities:
        values = F.map_values(probabilities)
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        checks += [(F.abs(total - 1) > 0.01, "probabilities_sum"), (F.exists(values, lambda p: (p < 0) | (p > 1)), "probability_range")]
    warnings = codes((F.unix_micros("end_time") - F.unix_micros("start_time") > 7 * 86_400_000_000, "long_session"), (F.col("event_count") > 10000, "many_events"))
    return sessions.withColumns({"errors": codes(*checks), "warnings": warnings})


def validate_households(households: DataFrame, members: DataFrame) -> DataFrame:
    """Adds errors to households (account_id, size, confidence, n_devices) from their members (account_id, person_id, share)."""
    summed = members.groupBy("account_id").agg(F.count("*").alias("n_members"), F.sum("share").alias("shares"))
    joined = households.join(summed, "account_id", "left")
    errors = codes(
        (F.col("size") < 1, "size_below_one"), (F.col("size") > 20, "size_above_twenty"), (~F.col("confidence").between(0, 1), "confidence_range"),
        (F.coalesce("n_members", F.lit(0)) != F.col("size"), "member_count"), (F.abs(F.col("shares") - 1) > 0.01, "shares_sum"),
    )
    return joined.withColumns({"errors": errors, "warnings": codes((F.col("n_devices") > 5 * F.col("size"), "many_devices"))})


def validate_distribution(rows: DataFrame, keys: list[str], share: str) -> DataFrame:
    """keys and whether their shares add up to one within a tenth."""
    return rows.groupBy(*keys).agg((F.round(F.abs(F.sum(share) - 1), 9) <= 0.1).alias("is_valid"))


def raise_on_errors(rows: DataFrame) -> DataFrame:
    """The rows without errors and warnings columns; reading them fails at the first invalid row."""
    ok = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("invalid row: "), F.array_join("errors", ", ")))).otherwise(F.lit(True))
    return rows.withColumn("_ok", ok).where("_ok").drop("_ok", "errors", "warnings")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
