"""Behavioural segments: engagement, intent, templates, channel efficacy and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsight.vocabulary import BASE_INTENT, PRICE_SENSITIVITY, SEGMENTS


def clip(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def engagement(sessions: Column, hours: Column, genres: Column) -> Column:
    return clip((0.3 * sessions + 0.5 * hours + 0.2 * genres) / 3)


def intent(persona: Column, engaged: Column) -> Column:
    return clip(lookup(persona, BASE_INTENT, 0.5) + (engaged - 0.5) * 0.3)


def enriched(persons: DataFrame) -> DataFrame:
    """Adds engagement, intent, price_sensitivity, discovery, context to persons (persona, sessions, hours, n_genres, household_size)."""
    p = F.col("persona")
    made = persons.withColumn("engagement", engagement(F.col("sessions"), F.col("hours"), F.col("n_genres")))
    return made.withColumns({
        "intent": intent(p, F.col("engagement")),
        "price_sensitivity": lookup(p, PRICE_SENSITIVITY, 0.5),
        "discovery": F.when(p.isin("teen", "child"), "recommendation").when(p == "primary_adult", "search").otherwise("browse"),
        "context": F.when(F.col("household_size") > 1, "co-viewing").otherwise("solo"),
    })


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p, i, d, e, f, r) for k, (p, i, d, e, f, r) in SEGMENTS.items()], "segment string, personas array<string>, least_intent double, device string, efficacy map<string,double>, frequency int, multiplier double")


def segments(persons: DataFrame) -> DataFrame:
    """segment, persona, size, share of all persons, value per person, mean intent: persons matched with the few templates."""
    t = F.broadcast(templates(persons.sparkSession))
    total = persons.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    fits = (F.col("intent") >= F.col("least_intent")) & (F.col("personas").isNull() | F.array_contains("personas", F.col("persona")))
    made = persons.join(t, fits).groupBy("segment", "persona").agg(F.count("*").alias("size"), F.avg("value").alias("average_value"), F.avg("intent").alias("mean_intent"))
    return made.withColumn("one", F.lit(1)).join(total, "one").withColumn("share", F.col("size") / F.col("total")).drop("one", "total")


def channel_attribution(made: DataFrame) -> DataFrame:
    """channel and its summed share times efficacy over segments."""
    t = templates(made.sparkSession).select("segment", F.explode("efficacy").alias("channel", "efficacy"))
    return made.join(F.broadcast(t), "segment").groupBy("channel").agg(F.sum(F.col("share") * F.col("efficacy")).alias("attributed"))


def recommendations(spark: SparkSession, k: int = 3) -> DataFrame:
    """segment, channel, rank, budget: the k most effective channels and their part of the budget."""
    spread = templates(spark).select("segment", "frequency", F.explode("efficacy").alias("channel", "efficacy"))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("efficacy"), "channel"))
    top = spread.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    return top.withColumn("budget", F.col("efficacy") / F.sum("efficacy").over(Window.partitionBy("segment"))).drop("efficacy")
