"""Household members and entities: summaries, labels, value splits, merges and similarity of device profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.vocabulary import ADULT_GENRES, BRACKET_TEEN_GENRES, DEVICE_TYPES, GENRES, KIDS_GENRES, PERSONA_PRIORS


def channel_or(channel: Column, other: Column) -> Column:
    """The channel, or another value where it is null or empty."""
    return F.coalesce(F.nullif(channel, F.lit("")), other)


def event_class(value: Column) -> Column:
    return F.when(value > 0, "conversion").otherwise("touchpoint")


def context_key(device: Column, intent: Column, person: Column) -> Column:
    """device_intent and, for an assigned session alone, person_ with the id's first four characters."""
    return F.concat_ws("_", device, intent, F.when(person.isNotNull(), F.concat(F.lit("person_"), F.substring(person, 1, 4))))


def age_brackets(amounts: DataFrame, key: str, genre: str = "genre", amount: str = "amount") -> DataFrame:
    """key, bracket by the largest of three sums of genre amounts, compared to six digits; on ties the older one."""
    of = lambda names: F.round(F.sum(F.when(F.col(genre).isin(*names), F.col(amount)).otherwise(0.0)), 6)
    made = amounts.groupBy(key).agg(of(KIDS_GENRES).alias("kids"), of(BRACKET_TEEN_GENRES).alias("teen"), of(ADULT_GENRES).alias("adult"))
    bracket = F.when((F.col("kids") > F.col("teen")) & (F.col("kids") > F.col("adult")), "child").when(F.col("teen") > F.col("adult"), "teen").otherwise("adult")
    return made.select(key, bracket.alias("bracket"))


def households(sessions: DataFrame, members: str = "device_id") -> DataFrame:
    """account_id, size, totals, the four hours with most sessions, most used device type, first and last activity.

    Hours and device types are counted first, so a household's sessions never meet in one task.
    """
    totals = sessions.groupBy("account_id").agg(F.countDistinct(members).alias("size"), F.count("*").alias("session_count"), F.sum("total_duration").alias("total_time"), F.sum("conversion_value").alias("conversion_value"), F.min("start_time").alias("first_seen"), F.max("end_time").alias("last_seen"))
    ranked = lambda c: sessions.groupBy("account_id", c).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("n"), c)))
    hours = ranked("hour_of_day").where("r <= 4").groupBy("account_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "hour_of_day"))), lambda x: x["hour_of_day"]).alias("peak_hours"))
    device = ranked("device_type").where("r = 1").select("account_id", F.col("device_type").alias("main_device"))
    return totals.join(hours, "account_id").join(device, "account_id")


def size_confidence(silhouette: Column) -> Column:
    return F.least(F.greatest(silhouette / 0.5, F.lit(0.0)), F.lit(1.0))


def equal_split(members: DataFrame, key: str) -> DataFrame:
    """Adds share: one over the members of the group."""
    return members.withColumn("share", 1.0 / F.count("*").over(Window.partitionBy(key)))


def value_by_member(shares: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """shares with each member's part of the group's value. values: key, value."""
    return shares.join(values, key).withColumn("attributed", F.col("share") * F.col("value"))


def described(bracket: Column, sessions: Column, genre: Column) -> Column:
    return F.format_string("%s, %d sessions, mostly %s", F.initcap(bracket), sessions, F.coalesce(genre, F.lit("nothing")))


def first_matches(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left with the first row of right that has its key, or nulls."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return left.join(right.withColumn("_nth", nth).where("_nth = 1").drop("_nth"), key, "left")


def device_by_fingerprint(device: Column, fingerprint: Column) -> Column:
    """The device type; unknown ones by substrings of the fingerprint, tv otherwise."""
    low = F.lower(fingerprint)
    return F.coalesce(device, F.when(low.rlike("tv|roku|apple_tv"), "tv").when(low.rlike("mobile|iphone|android"), "mobile").otherwise("tv"))


def merged_entities(entities: DataFrame, key: str) -> DataFrame:
    """One entity per key: united sets, sums, first and last times, confidence weighted by sessions."""
    weight = F.sum("session_count")
    confidence = F.when(weight > 0, F.sum(F.col("confidence") * F.col("session_count")) / weight).otherwise(F.avg("confidence"))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return entities.groupBy(key).agg(united("devices"), weight.alias("session_count"), F.sum("event_count").alias("event_count"), F.sum("conversion_value").alias("conversion_value"), confidence.alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the larger set's size; null where a set is empty."""
    size = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / size)


def weighted_mean(scores: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the scores that are not null, 0 without any."""
    total = reduce(lambda x, y: x + y, [F.coalesce(s * w, F.lit(0.0)) for s, w in scores])
    weights = reduce(lambda x, y: x + y, [F.when(s.isNotNull(), w).otherwise(0.0) for s, w in scores])
    return F.when(weights > 0, total / weights).otherwise(0.0)


def profile_similarity(ip: Column, hours: Column, genres: Column, duration_a: Column, duration_b: Column) -> Column:
    """Similarity of two device profiles from the signals that both have."""
    ratio = F.when((duration_a > 0) & (duration_b > 0), F.least(duration_a, duration_b) / F.greatest(duration_a, duration_b))
    return weighted_mean([(ip, 3.0), (hours, 1.0), (genres, 2.0), (ratio, 0.5)])


def engagement_depth(sessions: Column, hours: Column, genres: Column) -> Column:
    return F.least(F.greatest((sessions * 0.2 + hours * 0.5 + genres * 0.3) / 3, F.lit(0.0)), F.lit(1.0))


def preferences(spark) -> DataFrame:
    """persona, kind (device, genre, hour), name, weight: a fixed table; devices and genres sum to one, hours do not."""
    rows = []
    for persona, (_, hours, genres, devices) in PERSONA_PRIORS.items():
        for kind, every, liked, base, scaled in (("device", DEVICE_TYPES, devices, 0.2, True), ("genre", [*GENRES, *[g for g in genres if g not in GENRES]], genres, 0.1, True), ("hour", range(24), hours, 0.1, False)):
            weights = {str(x): 0.3 if x in liked else base for x in every}
            total = sum(weights.values()) if scaled else 1.0
            rows += [(persona, kind, name, w / total) for name, w in weights.items()]
    return spark.createDataFrame(rows, "persona string, kind string, name string, weight double")


def device_features(profiles: DataFrame) -> DataFrame:
    """device_id and features: device one-hot, 24 hour shares, genre shares, log averages, shared flag.

    profiles: device_id, primary_device, hours and genres (maps to shares), avg_duration, avg_events, shared.
    """
    kinds = [(F.col("primary_device") == d).cast("double") for d in [*DEVICE_TYPES, "unknown"]]
    hours = [F.coalesce(F.col("hours")[h], F.lit(0.0)) for h in range(24)]
    genres = [F.coalesce(F.col("genres")[g], F.lit(0.0)) for g in GENRES]
    return profiles.select("device_id", F.array(*kinds, *hours, *genres, F.log1p("avg_duration"), F.log1p("avg_events"), F.col("shared").cast("double")).alias("features"))
