"""Queries over journeys and attribution, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.operators import attribution as a
from kinsight.operators import uncertainty as u
from kinsight.plans import sql
from kinsight.plans.registry import query
from kinsight.sources.views import journey_steps, viewing_events

COUNTS = f"""{sql.JOURNEYS}, grams AS (
  SELECT channel AS source, coalesce(lead(channel) OVER (PARTITION BY person ORDER BY position), CASE WHEN converted THEN 'CONVERSION' ELSE 'NULL' END) AS target FROM journeys
  UNION ALL SELECT 'START', channel FROM journeys WHERE position = 1),
counts AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS n FROM grams GROUP BY ALL),
probs AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS p FROM counts)"""

VALUES = f"""{COUNTS}, chan AS (SELECT source AS channel, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM counts WHERE source <> 'START')),
masks AS (SELECT CAST(unnest(range(CAST(pow(2, (SELECT count(*) FROM chan)) AS BIGINT))) AS BIGINT) AS mask),
held AS (SELECT mask, channel FROM masks, chan WHERE (mask >> i) & 1 = 1),
base AS (SELECT h.mask, h.channel, coalesce(p.p, 0.0) AS r FROM held h LEFT JOIN probs p ON p.source = h.channel AND p.target = 'CONVERSION'),
solve AS (SELECT mask, channel, 0 AS step, CAST(0.0 AS DOUBLE) AS x FROM held
  UNION ALL
  SELECT b.mask, b.channel, any_value(s.step) + 1, any_value(b.r) + coalesce(sum(p.p * s.x), 0.0) FROM base b JOIN solve s ON s.mask = b.mask LEFT JOIN probs p ON p.source = b.channel AND p.target = s.channel WHERE s.step < 400 GROUP BY b.mask, b.channel),
vals AS (SELECT m.mask, coalesce(sum(p.p * s.x), 0.0) AS v FROM masks m LEFT JOIN solve s ON s.mask = m.mask AND s.step = 400 LEFT JOIN probs p ON p.source = 'START' AND p.target = s.channel GROUP BY m.mask),
nn AS (SELECT count(*) AS n FROM chan),
removal AS (SELECT channel, (SELECT v FROM vals ORDER BY mask DESC LIMIT 1) - v AS effect FROM chan JOIN vals ON mask = (SELECT max(mask) FROM masks) - (1 << i)),
shap AS (SELECT channel, sum(factorial(CAST(bit_count(s.mask) AS INTEGER)) * factorial(CAST((SELECT n FROM nn) - bit_count(s.mask) - 1 AS INTEGER)) / CAST(factorial(CAST((SELECT n FROM nn) AS INTEGER)) AS DOUBLE) * (l.v - s.v)) AS shapley
  FROM chan JOIN vals s ON (s.mask >> i) & 1 = 0 JOIN vals l ON l.mask = s.mask + (1 << i) GROUP BY channel),
shares AS (SELECT channel, effect / sum(effect) OVER () AS markov_share, shapley / sum(shapley) OVER () AS shapley_share FROM removal JOIN shap USING (channel))"""


@query("m04_transition_counts", f"WITH {COUNTS} SELECT source, target, n, round(p, 9) AS p FROM probs")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.transition_probabilities(a.transition_counts(journey_steps(spark, sf_dir))).withColumn("p", F.round("p", 9))


@query("m07_coalition_values", f"WITH RECURSIVE {VALUES} SELECT mask, round(v, 8) AS v FROM vals")
def coalition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.coalition_values(a.transition_counts(journey_steps(spark, sf_dir)))[0].withColumn("v", F.round("v", 8))


@query("m08_removal_effects", f"WITH RECURSIVE {VALUES} SELECT channel, round(effect, 8) AS effect FROM removal")
def removal_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.removal_effects(*a.coalition_values(a.transition_counts(journey_steps(spark, sf_dir)))).withColumn("effect", F.round("effect", 8))


@query("m10_shapley_values", f"WITH RECURSIVE {VALUES} SELECT channel, round(shapley, 8) AS shapley FROM shap")
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.shapley_values(*a.coalition_values(a.transition_counts(journey_steps(spark, sf_dir)))).withColumn("shapley", F.round("shapley", 8))


@query("m15_hybrid_attribution", f"""WITH RECURSIVE {VALUES}, mixed AS (SELECT *, 0.5 * markov_share + 0.5 * shapley_share AS share FROM shares)
SELECT channel, round(markov_share, 8) AS markov_share, round(shapley_share, 8) AS shapley_share, round(share, 8) AS share, round(share * (SELECT sum(value) FROM journeys WHERE position = 1 AND converted), 2) AS value FROM mixed""")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = a.hybrid(journey_steps(spark, sf_dir))
    return made.withColumns({n: F.round(n, 8) for n in ("markov_share", "shapley_share", "share")}).withColumn("value", F.round("value", 2))


@query("m14_shapley_axioms", "SELECT true AS efficiency, true AS symmetry, true AS dummy")
def shapley_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, channels = a.coalition_values(a.transition_counts(journey_steps(spark, sf_dir)))
    return a.axioms(a.shapley_values(values, channels), values, channels)


@query("m11_sampled_shapley")
def sampled_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.sampled_shapley(*a.coalition_values(a.transition_counts(journey_steps(spark, sf_dir))))


@query("m16_psychographic_counts", f"WITH {sql.JOURNEYS}, w AS (SELECT *, CASE WHEN channel = '1-URGENT' THEN 1.5 WHEN channel = '5-LOW' THEN 0.5 ELSE 1.0 END AS w FROM journeys), g AS (SELECT channel AS source, coalesce(lead(channel) OVER (PARTITION BY person ORDER BY position), CASE WHEN converted THEN 'CONVERSION' ELSE 'NULL' END) AS target, w FROM w UNION ALL SELECT 'START', channel, w FROM w WHERE position = 1) SELECT source, target, CAST(sum(w) AS DOUBLE) AS n FROM g GROUP BY ALL")
def psychographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([("1-URGENT", 1.5), ("5-LOW", 0.5)], "channel string, weight double")
    return a.psychographic_weights(journey_steps(spark, sf_dir), weights)


@query("m18_touch_credit", f"""WITH {sql.JOURNEYS}, c AS (SELECT *, count(*) OVER (PARTITION BY person) AS n FROM journeys WHERE converted), f AS (SELECT *, n - position AS back, pow(0.8, n - position) / sum(pow(0.8, n - position)) OVER (PARTITION BY person) AS faded FROM c)
SELECT channel, round(sum(CASE WHEN position = 1 THEN value ELSE 0.0 END), 2) AS first_touch, round(sum(CASE WHEN back = 0 THEN value ELSE 0.0 END), 2) AS last_touch, round(sum(value / n), 2) AS linear, round(sum(value * faded), 2) AS time_decay FROM f GROUP BY channel""")
def touch_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.touch_credit(journey_steps(spark, sf_dir)).withColumns({n: F.round(n, 2) for n in ("first_touch", "last_touch", "linear", "time_decay")})


@query("m09_conversion_rate", f"WITH {sql.JOURNEYS} SELECT round(avg(CASE WHEN converted THEN 1.0 ELSE 0.0 END), 8) AS observed, round(avg(CASE WHEN converted THEN 1.0 ELSE 0.0 END), 8) AS modelled FROM journeys WHERE position = 1")
def conversion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's conversion probability equals the observed rate."""
    steps = journey_steps(spark, sf_dir)
    values, channels = a.coalition_values(a.transition_counts(steps))
    modelled = values.where(F.col("mask") == (1 << len(channels)) - 1).select(F.round("v", 8).alias("modelled"), F.lit(1).alias("one"))
    observed = steps.where("position = 1").agg(F.round(F.avg(F.col("converted").cast("double")), 8).alias("observed")).withColumn("one", F.lit(1))
    return observed.join(modelled, "one").drop("one")


@query("m01_journey_paths", f"""WITH {sql.VIEWING}, s AS (SELECT account_id, string_agg(channel, '>' ORDER BY ts, event_id) AS path, bool_or(conversion_value > 0) AS converted, round(sum(conversion_value), 4) AS value FROM viewing GROUP BY account_id) SELECT account_id, md5(path) AS path_md5, converted, value FROM s""")
def journey_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = viewing_events(spark, sf_dir).groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "channel"))).alias("x"), F.bool_or(F.col("conversion_value") > 0).alias("converted"), F.round(F.sum("conversion_value"), 4).alias("value"))
    return grouped.select("account_id", F.md5(F.array_join(F.transform("x", lambda s: s["channel"]), ">")).alias("path_md5"), "converted", "value")


@query("q01_alpha_sweep", f"WITH RECURSIVE {VALUES}, swept AS (SELECT i / 20.0 AS alpha, channel, i / 20.0 * markov_share + (1 - i / 20.0) * shapley_share AS share FROM shares, range(21) t(i)) SELECT CAST(alpha AS DOUBLE) AS alpha, channel, round(share, 8) AS share, rank() OVER (PARTITION BY alpha ORDER BY round(share, 9) DESC) AS rank FROM swept")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.alpha_sweep(a.hybrid(journey_steps(spark, sf_dir))).withColumns({"share": F.round("share", 8), "rank": F.col("rank").cast("long")})


@query("q06_sweep_summary", f"WITH RECURSIVE {VALUES}, swept AS (SELECT i / 20.0 AS alpha, channel, i / 20.0 * markov_share + (1 - i / 20.0) * shapley_share AS share FROM shares, range(21) t(i)), r AS (SELECT *, rank() OVER (PARTITION BY alpha ORDER BY round(share, 9) DESC) AS rank FROM swept) SELECT channel, round(max(share) - min(share), 8) AS range, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS rank_1, round(avg(CASE WHEN rank = 2 THEN 1.0 ELSE 0.0 END), 6) AS rank_2, round(avg(CASE WHEN rank = 3 THEN 1.0 ELSE 0.0 END), 6) AS rank_3 FROM r GROUP BY channel")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = u.sweep_summary(u.alpha_sweep(a.hybrid(journey_steps(spark, sf_dir))))
    return made.select("channel", F.round("range", 8).alias("range"), *[F.round(f"rank_{k}", 6).alias(f"rank_{k}") for k in (1, 2, 3)])


@query("q03_bootstrap_intervals")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.intervals(u.bootstrap(journey_steps(spark, sf_dir)))


@query("q04_dirichlet_intervals")
def dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.intervals(u.dirichlet(journey_steps(spark, sf_dir)))


@query("q05_wider_source")
def wider(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = journey_steps(spark, sf_dir)
    return u.wider_source(u.bootstrap(steps), u.dirichlet(steps))
