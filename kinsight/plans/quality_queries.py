"""Queries over calibration, metrics, drift and cold start, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.operators import coldstart as cs
from kinsight.operators import drift as d
from kinsight.operators import evaluation as e
from kinsight.plans import sql
from kinsight.plans.profile_queries import BASE, both
from kinsight.plans.registry import query
from kinsight.sources.views import viewing_events
from kinsight.vocabulary import PERSONA_PRIORS

#: Predictions: the probability from a session's duration, the outcome from its conversion.
PRED = f"{BASE}, pred AS (SELECT session_id, account_id, device_id, device_type, start_time, 1 / (1 + exp(-(total_duration - 50) / 40)) AS p, CASE WHEN conversion_value > 0 THEN 1.0 ELSE 0.0 END AS y FROM sessions)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0]
    return made.select("session_id", "account_id", "device_id", "device_type", "start_time", (1 / (1 + F.exp(-(F.col("total_duration") - 50) / 40))).alias("p"), F.when(F.col("conversion_value") > 0, 1.0).otherwise(0.0).alias("y"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


BINS = "bins AS (SELECT round_even(p, 1) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM pred GROUP BY 1)"


@query("e08_reliability_bins", f"WITH {PRED}, {BINS} SELECT CAST(bin AS DOUBLE) AS bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM bins")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e.reliability(predictions(spark, sf_dir)), "mean_p", "rate")


@query("e08_calibration", f"""WITH {PRED}, {BINS}, s AS (SELECT count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(y) AS base FROM pred), g AS (SELECT sum(abs(mean_p - rate) * n) / sum(n) AS ece, max(abs(mean_p - rate)) AS mce FROM bins),
k AS (SELECT *, 1 - brier / (base * (1 - base)) AS skill FROM s, g) SELECT n, round(brier, 6) AS brier, round(ece, 6) AS ece, round(mce, 6) AS mce, round(skill, 6) AS skill, CASE WHEN skill > 0.7 THEN 'excellent' WHEN skill > 0.5 THEN 'good' WHEN skill > 0.2 THEN 'fair' ELSE 'poor' END AS grade FROM k""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e.calibration(predictions(spark, sf_dir)), "brier", "ece", "mce", "skill")


@query("e09_temperature", f"WITH {PRED} SELECT session_id, round(1 / (1 + exp(-ln(p / (1 - p)) / ((SELECT avg(p) FROM pred) / 0.5))), 6) AS calibrated FROM pred")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.temperature_scaled(predictions(spark, sf_dir)).select("session_id", F.round("calibrated", 6).alias("calibrated"))


@query("e05_accuracy_by_device", f"WITH {PRED} SELECT device_type, count(*) AS n, round(avg(y), 6) AS accuracy, round(avg(p), 6) AS mean_p, round(avg(pow(p - y, 2)), 6) AS brier, round(abs(avg(y) - avg(p)), 6) AS gap, CASE WHEN avg(y) < 0.6 THEN 'critical' WHEN avg(y) < 0.7 THEN 'warning' ELSE 'none' END AS action FROM pred GROUP BY device_type HAVING count(*) >= 10")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e.actions(e.accuracy_by(predictions(spark, sf_dir), ["device_type"])), "accuracy", "mean_p", "brier", "gap")


@query("e12_assignment_scores", f"""WITH {BASE}, c AS (SELECT device_type AS truth, first_channel, CASE first_channel WHEN 'Email' THEN 'tv' WHEN 'Search' THEN 'desktop' WHEN 'Display' THEN 'mobile' ELSE 'tablet' END AS guess FROM sessions),
p AS (SELECT guess AS class, count(*) AS np, count(CASE WHEN guess = truth THEN 1 END) AS tp FROM c GROUP BY 1), t AS (SELECT truth AS class, count(*) AS nt FROM c GROUP BY 1),
j AS (SELECT class, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(nt, 0) - coalesce(tp, 0) AS fn FROM p FULL JOIN t USING (class)),
k AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM j) SELECT class, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM k""")
def assignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("first_channel") == "Email", "tv").when(F.col("first_channel") == "Search", "desktop").when(F.col("first_channel") == "Display", "mobile").otherwise("tablet")
    return rounded(e.classification(both(spark, sf_dir)[0].withColumn("guess", guess), "guess", "device_type"), "precision", "recall", "f1")


@query("e11_household_size_error", f"WITH {BASE}, s AS (SELECT account_id, count(DISTINCT device_id) AS size, count(DISTINCT device_type) AS true_size FROM sessions WHERE event_count > 1 GROUP BY account_id) SELECT round(avg(abs(size - true_size)), 6) AS mae, round(avg(CASE WHEN size = true_size THEN 1.0 ELSE 0.0 END), 6) AS exact FROM s")
def size_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0].where("event_count > 1").groupBy("account_id").agg(F.countDistinct("device_id").alias("size"), F.countDistinct("device_type").alias("true_size"))
    return rounded(e.size_error(made), "mae", "exact")


ERF = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-(abs(z) / sqrt(2.0)) * (abs(z) / sqrt(2.0)))"


@query("e17_two_proportions", f"""WITH {PRED}, s AS (SELECT device_type, count(CASE WHEN y = 1 THEN 1 END) AS x1, count(*) AS n1 FROM pred GROUP BY 1), a AS (SELECT sum(x1) AS x2, sum(n1) AS n2 FROM s),
q AS (SELECT device_type, (x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z FROM s, a), r AS (SELECT device_type, z, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2.0))) AS t FROM q)
SELECT device_type, round(z, 6) AS z, round(2 * (1 - 0.5 * (1 + (1 - {ERF}))), 6) AS p_value FROM r""")
def two_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = predictions(spark, sf_dir).groupBy("device_type").agg(F.sum("y").alias("x1"), F.count("*").alias("n1"))
    every = by.agg(F.sum("x1").alias("x2"), F.sum("n1").alias("n2")).withColumn("one", F.lit(1))
    return rounded(e.two_proportions(by.withColumn("one", F.lit(1)).join(every, "one")).select("device_type", "z", "p_value"), "z", "p_value")


@query("e18_disparate_impact", f"WITH {PRED}, g AS (SELECT device_type, count(*) AS n, avg(y) AS rate FROM pred GROUP BY 1) SELECT device_type, n, round(rate, 6) AS rate, round(min(rate) OVER () / max(rate) OVER (), 6) AS impact FROM g")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e.disparate_impact(predictions(spark, sf_dir), "device_type", "y"), "rate", "impact")


@query("e03_implicit_feedback", f"WITH {PRED}, l AS (SELECT a.session_id AS id, count(*) AS n, count(DISTINCT b.device_id) AS devices FROM pred a JOIN sessions b USING (account_id) WHERE epoch_us(b.start_time) - epoch_us(a.start_time) >= 86400000000 GROUP BY 1) SELECT id FROM l WHERE n >= 3 AND devices = 1")
def implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0]
    return e.implicit_feedback(made.select(F.col("session_id").alias("id"), "account_id", F.col("start_time").alias("at")), made)


HALVES = f"{BASE}, b AS (SELECT * FROM sessions WHERE start_time < TIMESTAMP '2024-01-16'), c AS (SELECT * FROM sessions WHERE start_time >= TIMESTAMP '2024-01-16')"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made, cut = both(spark, sf_dir)[0], F.lit("2024-01-16").cast("timestamp")
    return made.where(F.col("start_time") < cut), made.where(F.col("start_time") >= cut)


@query("dr03_peak_shift", f"""WITH {HALVES}, tb AS (SELECT account_id, hour_of_day AS h FROM (SELECT account_id, hour_of_day, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, hour_of_day) AS r FROM b GROUP BY 1, 2) WHERE r <= 3),
tc AS (SELECT account_id, hour_of_day AS h FROM (SELECT account_id, hour_of_day, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, hour_of_day) AS r FROM c GROUP BY 1, 2) WHERE r <= 3),
n AS (SELECT tc.account_id, tc.h, min(abs(tb.h - tc.h)) AS d FROM tc JOIN tb USING (account_id) GROUP BY 1, 2), s AS (SELECT account_id, avg(least(d, 24 - d)) AS shift FROM n GROUP BY 1)
SELECT account_id, round(shift, 6) AS shift, round(CASE WHEN shift > 3 THEN least(shift / 6, 1.0) ELSE 0.0 END, 6) AS severity FROM s""")
def peak_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.peak_shift(*halves(spark, sf_dir), "account_id"), "shift", "severity")


@query("dr05_composition", f"""WITH {HALVES}, sb AS (SELECT account_id, device_id, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY account_id) AS s FROM b GROUP BY account_id, device_id), sc AS (SELECT account_id, device_id, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY account_id) AS s FROM c GROUP BY account_id, device_id),
j AS (SELECT account_id, sb.s AS b, sc.s AS c FROM sb FULL JOIN sc USING (account_id, device_id)), k AS (SELECT account_id, count(CASE WHEN j.b IS NULL THEN 1 END) AS n_new, count(CASE WHEN j.c IS NULL THEN 1 END) AS n_removed, coalesce(sum(CASE WHEN j.b > 0 THEN pow(coalesce(j.c, 0.0) - j.b, 2) / j.b END), 0.0) AS chi_square FROM j GROUP BY 1)
SELECT account_id, n_new, n_removed, round(chi_square, 6) AS chi_square, CASE WHEN n_new > 0 THEN 'COMPOSITION_NEW' WHEN n_removed > 0 THEN 'COMPOSITION_REMOVED' WHEN chi_square > 0.5 THEN 'BEHAVIORAL' ELSE 'NONE' END AS kind,
  round(CASE WHEN n_new > 0 THEN 0.7 WHEN n_removed > 0 THEN 0.5 WHEN chi_square > 0.5 THEN least(chi_square, 1.0) ELSE 0.0 END, 6) AS severity FROM k""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.composition(*halves(spark, sf_dir), "account_id", "device_id"), "chi_square", "severity")


@query("dr06_weekend_change", f"WITH {HALVES}, rb AS (SELECT account_id, avg(CASE WHEN day_of_week >= 5 THEN 1.0 ELSE 0.0 END) AS r FROM b GROUP BY 1), rc AS (SELECT account_id, avg(CASE WHEN day_of_week >= 5 THEN 1.0 ELSE 0.0 END) AS r FROM c GROUP BY 1) SELECT account_id, round(abs(rc.r - rb.r), 6) AS change, CASE WHEN abs(rc.r - rb.r) <= 0.15 THEN 'NONE' ELSE 'SEASONAL' END AS kind FROM rb JOIN rc USING (account_id)")
def weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.weekend_change(*halves(spark, sf_dir), "account_id", F.lit(1)), "change")


@query("dr07_volume", f"WITH {HALVES}, nb AS (SELECT account_id, count(*) AS n FROM b GROUP BY 1), nc AS (SELECT account_id, count(*) AS n FROM c GROUP BY 1) SELECT account_id, round(coalesce(nc.n, 0) / (nb.n * 16.0 / 15.0), 6) AS ratio, coalesce(nc.n, 0) / (nb.n * 16.0 / 15.0) < 0.5 AS missing FROM nb LEFT JOIN nc USING (account_id)")
def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.volume(*halves(spark, sf_dir), "account_id", 15.0, 16.0), "ratio")


@query("dr12_distance_drift", f"""WITH {sql.VIEWING}, r AS (SELECT account_id, duration_sec AS v, row_number() OVER (PARTITION BY account_id ORDER BY event_id DESC) AS nth FROM viewing),
m AS (SELECT account_id, avg(CASE WHEN nth <= 50 THEN v END) AS now, avg(CASE WHEN nth > 50 THEN v END) AS base, stddev_pop(CASE WHEN nth > 50 THEN v END) AS spread FROM r GROUP BY 1) SELECT account_id, coalesce(round(CASE WHEN spread > 0 THEN abs(now - base) / spread END, 6), -1.0) AS z, coalesce(CASE WHEN spread > 0 THEN abs(now - base) / spread END > 2, false) AS drifted FROM m""")
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.distance_drift(viewing_events(spark, sf_dir), "account_id", "duration_sec", "event_id").select("account_id", F.coalesce("z", F.lit(-1.0)).alias("z"), "drifted"), "z")


def _score(persona: str) -> str:
    prior, hours, genres, devices = PERSONA_PRIORS[persona]
    text = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    return f"{prior} * CASE WHEN hour_of_day IN {tuple(hours)} THEN 2.0 ELSE 1.0 END * CASE WHEN device_type IN {text(devices)} THEN 1.5 ELSE 1.0 END * CASE WHEN primary_genre IN {text(genres)} THEN 1.5 ELSE 1.0 END"


@query("k01_strategies", f"WITH {BASE}, n AS (SELECT device_id, count(*) AS n FROM sessions GROUP BY 1) SELECT device_id, n, CASE WHEN n >= 10 THEN 'ready_for_clustering' WHEN n < 3 THEN 'account_level' WHEN n < 7 THEN 'probabilistic_prior' ELSE 'heuristic' END AS strategy, greatest(10 - n, 0) AS needed FROM n")
def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = both(spark, sf_dir)[0].groupBy("device_id").agg(F.count("*").alias("n"))
    return counts.select("device_id", "n", cs.strategy(F.col("n")).alias("strategy"), cs.progress(F.col("n"))[0].alias("needed"))


@query("k02_prior_personas", f"""WITH {BASE}, pg AS (SELECT account_id, device_id, session_no, arg_min(genre, (-seconds, genre)) AS primary_genre FROM genres GROUP BY ALL), s AS (SELECT * FROM sessions JOIN pg USING (account_id, device_id, session_no)),
x AS (SELECT session_id, unnest([{', '.join(f"{{'p': {_score(p)}, 'i': {i}, 'persona': '{p}'}}" for i, p in enumerate(PERSONA_PRIORS))}], recursive := true) FROM s),
y AS (SELECT session_id, persona, p / sum(p) OVER (PARTITION BY session_id) AS p, row_number() OVER (PARTITION BY session_id ORDER BY p DESC, i) AS r FROM x) SELECT session_id, persona, round(p, 6) AS confidence FROM y WHERE r = 1""")
def prior_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.operators.sessions import with_primary_genre

    made = with_primary_genre(*both(spark, sf_dir))
    rows = made.select("session_id", F.col("hour_of_day").alias("hour"), F.col("device_type").alias("device"), F.array("primary_genre").alias("genres"))
    return cs.prior_assignment(rows).select("session_id", "persona", F.round("confidence", 6).alias("confidence"))


@query("k03_heuristic_personas", f"""WITH {BASE}, mh AS (SELECT device_id, arg_min(hour_of_day, (-n, hour_of_day)) AS hour FROM (SELECT device_id, hour_of_day, count(*) AS n FROM sessions GROUP BY ALL) GROUP BY 1), md AS (SELECT device_id, arg_min(device_type, (-n, device_type)) AS device FROM (SELECT device_id, device_type, count(*) AS n FROM sessions GROUP BY ALL) GROUP BY 1),
mg AS (SELECT device_id, arg_min(genre, (-n, genre)) AS genre FROM (SELECT device_id, genre, count(*) AS n FROM genres GROUP BY ALL) GROUP BY 1), cf AS (SELECT device_id, 0.5 + (1 - count(DISTINCT hour_of_day) / count(*)) * 0.3 AS confidence FROM sessions GROUP BY 1)
SELECT device_id, round(confidence, 6) AS confidence, CASE WHEN hour BETWEEN 10 AND 17 AND genre IN ('Kids', 'Animation', 'Family') THEN 'child' WHEN hour IN (21, 22, 23, 0, 1) AND (device IN ('mobile', 'tablet') OR genre IN ('Action', 'SciFi', 'Fantasy')) THEN 'teen'
  WHEN device = 'tv' AND hour BETWEEN 19 AND 23 THEN 'primary_adult' WHEN genre IN ('Documentary', 'News', 'Classics') THEN 'secondary_adult' ELSE 'primary_adult' END AS persona FROM mh JOIN md USING (device_id) JOIN mg USING (device_id) JOIN cf USING (device_id)""")
def heuristic_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.heuristic_assignment(*both(spark, sf_dir), "device_id").select("device_id", F.round("confidence", 6).alias("confidence"), "persona")
