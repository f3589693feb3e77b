"""Device, person and household profiles; shares; ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.vocabulary import KIDS_GENRES, TEEN_GENRES


def distribution(rows: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """keys, value, amount and share of the keys' total."""
    amounts = rows.groupBy(*keys, value).agg((F.sum(weight) if weight is not None else F.count("*")).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy(*keys))
    return amounts.withColumn("share", F.when(total > 0, F.col("amount") / total).otherwise(0.0))


def top_k(rows: DataFrame, keys: list[str], value: str, amount: str, k: int) -> DataFrame:
    """The k values with the largest amount by keys, with their rank; ties go to the smaller value, nulls last.

    Amounts are compared to six digits, so that the order in which they were added decides nothing.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(amount, 6)), F.asc_nulls_last(value)))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def profiles(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Session counts, times, first and last activity, mode device, distinct accounts and conversions by keys."""
    return sessions.groupBy(*keys).agg(
        F.count("*").alias("session_count"),
        F.sum("total_duration").alias("total_time"),
        F.avg("total_duration").alias("avg_duration"),
        F.avg("event_count").alias("avg_events"),
        F.min("start_time").alias("first_seen"),
        F.max("end_time").alias("last_seen"),
        F.mode("device_type", deterministic=True).alias("primary_device"),
        F.countDistinct("account_id").alias("n_accounts"),
        F.sum("conversion_value").alias("conversion_value"),
        F.count(F.when(F.col("conversion_value") > 0, 1)).alias("conversions"),
        F.max(F.col("day_of_week") >= 5).alias("active_weekend"),
        F.max(F.col("day_of_week") < 5).alias("active_weekday"),
    )


def hours_between(hour: Column, *hours: int) -> Column:
    return hour.isin(list(hours))


def room(device_type: Column, late: Column, evening: Column, office: Column) -> Column:
    """Room of a device: late, evening and office are its shares of the hours 23-5, 18-22 and 9-17."""
    return (
        F.when(device_type == "tv", F.when(late > 0.5 * evening, "bedroom").otherwise("living_room"))
        .when(device_type == "desktop", F.when(office > 0.4, "office").otherwise("bedroom"))
        .when(device_type.isin("mobile", "tablet"), "portable")
        .otherwise("unknown")
    )


def device_rooms(sessions: DataFrame) -> DataFrame:
    """device_id, room, is_shared, genre-free part: hours used and peaks."""
    hours = distribution(sessions, ["device_id"], "hour_of_day")
    hour = F.col("hour_of_day")
    # one division of counts, so that ties are ties whatever the order of the rows
    pick = lambda *h: F.sum(F.when(hours_between(hour, *h), F.col("amount")).otherwise(0)) / F.sum("amount")
    sums = hours.groupBy("device_id").agg(
        pick(23, 0, 1, 2, 3, 4, 5).alias("late"), pick(*range(18, 23)).alias("evening"), pick(*range(9, 18)).alias("office"),
        F.count(F.when(F.col("share") > 0.05, 1)).alias("used_hours"), F.count(F.when(F.col("share") > 0.1, 1)).alias("peak_hours"),
    )
    types = sessions.groupBy("device_id").agg(F.min_by("device_type", F.struct("start_time", "session_id")).alias("device_type"))
    return sums.join(types, "device_id").withColumn("room", room(F.col("device_type"), F.col("late"), F.col("evening"), F.col("office")))


def genre_entropy(genres: DataFrame, keys: list[str], n_genres: int = 10) -> DataFrame:
    """keys and the genre entropy divided by its maximum."""
    shares = distribution(genres, keys, "genre", F.col("seconds"))
    return shares.groupBy(*keys).agg((-F.sum(F.col("share") * F.log(F.col("share") + 1e-10)) / F.log(F.lit(float(n_genres)))).alias("entropy"))


def shared_devices(sessions: DataFrame, genres: DataFrame) -> DataFrame:
    """device_id, is_shared: many used hours with several peaks, or very mixed genres."""
    joined = device_rooms(sessions).join(genre_entropy(genres, ["device_id"]), "device_id", "left")
    return joined.withColumn("is_shared", ((F.col("used_hours") > 12) & (F.col("peak_hours") > 3)) | (F.coalesce("entropy", F.lit(0.0)) > 0.7))


def personas(sessions: DataFrame, genres: DataFrame, key: str) -> DataFrame:
    """key, persona: child, teen, primary_adult or secondary_adult by genres, hours, device and activity."""
    # a part of the whole in one division: sums of rounded shares miss limits that counts just reach
    part = lambda names: F.sum(F.when(F.col("genre").isin(names), F.col("seconds")).otherwise(0.0)) / F.nullif(F.sum("seconds"), F.lit(0.0))
    g = genres.groupBy(key).agg(part(KIDS_GENRES).alias("kids"), part(TEEN_GENRES).alias("teens"))
    among = lambda hours: F.avg(F.when(F.col("hour_of_day").isin(hours), 1.0).otherwise(0.0))
    h = sessions.groupBy(key).agg(among([*range(14, 19)]).alias("afternoon"), among([19, 20, 21, 22, 23, 0, 1]).alias("evening"))
    made = profiles(sessions, [key]).select(key, "session_count", "primary_device") if key == "account_id" else sessions.groupBy(key).agg(F.count("*").alias("session_count"), F.mode("device_type", deterministic=True).alias("primary_device"))
    persona = (
        F.when((F.col("kids") > 0.5) & (F.col("afternoon") > 0.3), "child")
        .when((F.col("teens") > 0.6) & (F.col("evening") > 0.5) & F.col("primary_device").isin("mobile", "tablet"), "teen")
        .when(F.col("session_count") > 50, "primary_adult")
        .otherwise("secondary_adult")
    )
    return made.join(g, key, "left").join(h, key, "left").withColumn("persona", persona)


def household_type(members: DataFrame, key: str = "account_id") -> DataFrame:
    """key, size, household_type from members' personas."""
    sums = members.groupBy(key).agg(F.count("*").alias("size"), F.count(F.when(F.col("persona").isin("child", "teen"), 1)).alias("young"), F.count(F.when(F.col("persona").isin("primary_adult", "secondary_adult"), 1)).alias("adults"))
    kind = F.when(F.col("size") == 1, "single").when(F.col("young") > 0, "family").when(F.col("adults") == 2, "couple").when(F.col("adults") > 2, "roommates").otherwise("unknown")
    return sums.withColumn("household_type", kind).select(key, "size", "household_type")


def shares(members: DataFrame, group: str, amount: str) -> DataFrame:
    """Adds share: the member's part of the group's amount, or an equal part where that is zero."""
    within = Window.partitionBy(group)
    total = F.sum(amount).over(within)
    return members.withColumn("share", F.when(total > 0, F.col(amount) / total).otherwise(1 / F.count("*").over(within)))


def labelled_members(members: DataFrame, group: str, member: str, amount: str) -> DataFrame:
    """Adds rank by amount and the label Person A, B, ... of each member in its group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(amount), member))
    return members.withColumn("rank", rank.cast("long")).withColumn("label", F.concat(F.lit("Person "), F.char(F.col("rank") + 64)))


def time_label(mean_hour: Column) -> Column:
    return F.when(mean_hour.isNull(), "Unknown").when(mean_hour.between(5, 11.999999), "Morning").when((mean_hour >= 12) & (mean_hour < 17), "Afternoon").when((mean_hour >= 17) & (mean_hour < 21), "Evening").otherwise("Night Owl")


def context_key(device_type: Column, event_count: Column, duration: Column, persona: Column) -> Column:
    """device, intent and persona joined by underscores; nulls in persona are left out."""
    intent = F.when(event_count.isNull(), "unknown_intent").when((event_count > 10) | (duration > 3600), "high_intent").when(event_count > 3, "medium_intent").otherwise("low_intent")
    return F.concat_ws("_", F.coalesce(device_type, F.lit("unknown")), intent, persona)


def percentiles(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """p50, p95, p99 (interpolated), mean and count."""
    p = lambda q: F.expr(f"percentile({value}, {q})")
    return rows.groupBy(*(keys or [])).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(value).alias("mean"), F.count("*").alias("n"))
