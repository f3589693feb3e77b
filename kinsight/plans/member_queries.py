"""Queries over household members, entities, feedback, baselines and new regimes, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.functions import validation as v
from kinsight.operators import clustering as c
from kinsight.operators import drift as d
from kinsight.operators import evaluation as e
from kinsight.operators import members as m
from kinsight.operators import privacy
from kinsight.operators import profiles as p
from kinsight.operators import uncertainty as u
from kinsight.plans import sql
from kinsight.plans.clustering_queries import GIVEN, points
from kinsight.plans.governance_queries import log as audit_log
from kinsight.plans.profile_queries import BASE, both
from kinsight.plans.quality_queries import BINS, PRED, predictions, rounded
from kinsight.plans.registry import query
from kinsight.sources.views import read_table, viewing_events
from kinsight.vocabulary import ADULT_GENRES, BRACKET_TEEN_GENRES, KIDS_GENRES


def in_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("p10_channel_and_class", f"WITH {sql.VIEWING}, x AS (SELECT *, CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN NULL ELSE channel END AS seen FROM viewing) SELECT coalesce(nullif(seen, ''), 'Direct') AS channel, coalesce(nullif(seen, ''), device_type) AS channel_or_device, CASE WHEN conversion_value > 0 THEN 'conversion' ELSE 'touchpoint' END AS class, count(*) AS n FROM x GROUP BY ALL")
def channel_and_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 11 == 0, F.lit(None)).otherwise(F.col("channel"))
    events = viewing_events(spark, sf_dir).withColumn("seen", seen)
    made = events.select(m.channel_or(F.col("seen"), F.lit("Direct")).alias("channel"), m.channel_or(F.col("seen"), F.col("device_type")).alias("channel_or_device"), m.event_class(F.col("conversion_value")).alias("class"))
    return made.groupBy("channel", "channel_or_device", "class").agg(F.count("*").alias("n"))


@query("p13_context_with_person", f"WITH {BASE} SELECT session_id, concat_ws('_', device_type, CASE WHEN event_count > 5 THEN 'high' ELSE 'low' END, CASE WHEN hour_of_day % 2 = 0 THEN 'person_' || substr(session_id, 1, 4) END) AS context FROM sessions")
def context_with_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = F.when(F.col("hour_of_day") % 2 == 0, F.col("session_id"))
    intent = F.when(F.col("event_count") > 5, "high").otherwise("low")
    return both(spark, sf_dir)[0].select("session_id", m.context_key(F.col("device_type"), intent, person).alias("context"))


BRACKETS = f"""br AS (SELECT account_id, sum(CASE WHEN genre IN {in_list(KIDS_GENRES)} THEN seconds ELSE 0.0 END) AS kids, sum(CASE WHEN genre IN {in_list(BRACKET_TEEN_GENRES)} THEN seconds ELSE 0.0 END) AS teen, sum(CASE WHEN genre IN {in_list(ADULT_GENRES)} THEN seconds ELSE 0.0 END) AS adult FROM genres GROUP BY account_id),
brackets AS (SELECT account_id, CASE WHEN kids > teen AND kids > adult THEN 'child' WHEN teen > adult THEN 'teen' ELSE 'adult' END AS bracket FROM br)"""


@query("p18_age_brackets", f"WITH {BASE}, {BRACKETS} SELECT * FROM brackets")
def age_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.age_brackets(both(spark, sf_dir)[1], "account_id", "genre", "seconds")


@query("p20_descriptions", f"""WITH {BASE}, {BRACKETS}, n AS (SELECT account_id, count(*) AS n FROM sessions GROUP BY account_id), g AS (SELECT account_id, arg_min(genre, (-s, genre)) AS genre FROM (SELECT account_id, genre, round(sum(seconds), 6) AS s FROM genres GROUP BY ALL) GROUP BY account_id)
SELECT account_id, upper(bracket[1]) || bracket[2:] || ', ' || n || ' sessions, mostly ' || coalesce(genre, 'nothing') AS description FROM brackets JOIN n USING (account_id) LEFT JOIN g USING (account_id)""")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, genres = both(spark, sf_dir)
    main = genres.where("genre IS NOT NULL").groupBy("account_id", "genre").agg(F.round(F.sum("seconds"), 6).alias("s")).groupBy("account_id").agg(F.min_by("genre", F.struct(F.col("s").isNull(), -F.col("s"), F.col("genre"))).alias("genre"))
    counts = made.groupBy("account_id").agg(F.count("*").alias("n"))
    joined = m.age_brackets(genres, "account_id", "genre", "seconds").join(counts, "account_id").join(main, "account_id", "left")
    return joined.select("account_id", m.described(F.col("bracket"), F.col("n"), F.col("genre")).alias("description"))


@query("a06_households", f"""WITH {BASE}, t AS (SELECT account_id, count(DISTINCT device_id) AS size, count(*) AS session_count, round(sum(total_duration), 4) AS total_time, round(sum(conversion_value), 4) AS conversion_value, epoch_us(min(start_time)) AS first_seen, epoch_us(max(end_time)) AS last_seen FROM sessions GROUP BY account_id),
h AS (SELECT account_id, string_agg(hour_of_day, ',' ORDER BY r) AS peak_hours FROM (SELECT account_id, hour_of_day, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, hour_of_day) AS r FROM sessions GROUP BY account_id, hour_of_day) WHERE r <= 4 GROUP BY account_id),
v AS (SELECT account_id, arg_min(device_type, (-n, device_type)) AS main_device FROM (SELECT account_id, device_type, count(*) AS n FROM sessions GROUP BY ALL) GROUP BY account_id) SELECT * FROM t JOIN h USING (account_id) JOIN v USING (account_id)""")
def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = m.households(both(spark, sf_dir)[0])
    return made.withColumns({"total_time": F.round("total_time", 4), "conversion_value": F.round("conversion_value", 4), "peak_hours": F.array_join("peak_hours", ","), "first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")})


MEMBERS = "mem AS (SELECT account_id, device_id, count(*) AS session_count, sum(total_duration) AS engagement FROM sessions GROUP BY ALL), vals AS (SELECT account_id, sum(conversion_value) AS value FROM sessions GROUP BY account_id)"


def member_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = both(spark, sf_dir)[0]
    return made.groupBy("account_id", "device_id").agg(F.count("*").alias("session_count"), F.sum("total_duration").alias("engagement")), made.groupBy("account_id").agg(F.sum("conversion_value").alias("value"))


@query("a08_equal_split", f"WITH {BASE}, {MEMBERS} SELECT account_id, device_id, round(1.0 / count(*) OVER (PARTITION BY account_id), 6) AS share FROM mem")
def equal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.equal_split(member_rows(spark, sf_dir)[0], "account_id").select("account_id", "device_id", F.round("share", 6).alias("share"))


@query("a10_value_by_member", f"WITH {BASE}, {MEMBERS}, s AS (SELECT account_id, device_id, CASE WHEN sum(engagement) OVER w > 0 THEN engagement / sum(engagement) OVER w ELSE 1.0 / count(*) OVER w END AS share FROM mem WINDOW w AS (PARTITION BY account_id)) SELECT account_id, device_id, round(share, 6) AS share, round(share * value, 4) AS attributed FROM s JOIN vals USING (account_id)")
def value_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, values = member_rows(spark, sf_dir)
    made = m.value_by_member(p.shares(rows, "account_id", "engagement"), values, "account_id")
    return made.select("account_id", "device_id", F.round("share", 6).alias("share"), F.round("attributed", 4).alias("attributed"))


@query("a15_dataset_statistics", f"WITH {BASE}, x AS (SELECT account_id, count(*) AS n, count(DISTINCT device_id) AS size FROM sessions GROUP BY account_id) SELECT count(*) AS households, round(avg(n), 6) AS sessions_each, round(avg(size), 6) AS members_each FROM x")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = both(spark, sf_dir)[0].groupBy("account_id").agg(F.count("*").alias("n"), F.countDistinct("device_id").alias("size"))
    return each.agg(F.count("*").alias("households"), F.round(F.avg("n"), 6).alias("sessions_each"), F.round(F.avg("size"), 6).alias("members_each"))


@query("j02_session_household", f"WITH {BASE}, h AS (SELECT account_id, count(DISTINCT device_id) AS size FROM sessions WHERE device_type <> 'tablet' GROUP BY account_id) SELECT session_id, account_id, size FROM sessions JOIN h USING (account_id)")
def session_household(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0]
    found = made.where("device_type != 'tablet'").groupBy("account_id").agg(F.countDistinct("device_id").alias("size"))
    return made.join(found, "account_id").select("session_id", "account_id", "size")


@query("j03_event_household", f"WITH {sql.VIEWING}, h AS (SELECT account_id, min(device_id) AS household FROM viewing WHERE event_type = 'purchase' GROUP BY account_id) SELECT event_id, household FROM viewing LEFT JOIN h USING (account_id)")
def event_household(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = viewing_events(spark, sf_dir)
    found = events.where("event_type = 'purchase'").groupBy("account_id").agg(F.min("device_id").alias("household"))
    return events.join(found, "account_id", "left").select("event_id", "household")


@query("j10_household_truth", f"WITH {BASE}, h AS (SELECT 'account_' || account_id AS id, count(DISTINCT device_id) AS size FROM sessions GROUP BY account_id), t AS (SELECT 'household_' || account_id AS truth_id, count(DISTINCT device_type) AS true_size FROM sessions GROUP BY account_id) SELECT id, size, true_size FROM h JOIN t ON truth_id = replace(id, 'account_', 'household_')")
def household_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0]
    told = made.groupBy(F.concat(F.lit("account_"), "account_id").alias("id")).agg(F.countDistinct("device_id").alias("size"))
    truth = made.groupBy(F.concat(F.lit("household_"), "account_id").alias("truth_id")).agg(F.countDistinct("device_type").alias("true_size"))
    return told.join(truth, F.col("truth_id") == F.replace("id", F.lit("account_"), F.lit("household_"))).select("id", "size", "true_size")


@query("j13_graduated", f"WITH {BASE}, r AS (SELECT device_type, device_id, row_number() OVER (PARTITION BY device_type ORDER BY device_id) AS r FROM (SELECT DISTINCT device_type, device_id FROM sessions)) SELECT session_id, 'cold_' || s.device_type AS placeholder, r.device_id AS person FROM sessions s LEFT JOIN r ON r.device_type = s.device_type AND r = 1")
def graduated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0]
    persons = made.select("device_type", F.col("device_id").alias("person")).distinct()
    joined = m.first_matches(made.select("session_id", "device_type"), persons, "device_type", "person")
    return joined.select("session_id", F.concat(F.lit("cold_"), "device_type").alias("placeholder"), "person")


@query("k06_devices_by_fingerprint", f"WITH {sql.VIEWING}, f AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN device_type END AS device_type, CASE k % 5 WHEN 0 THEN 'Roku-' || k WHEN 1 THEN 'iPhone-' || k WHEN 2 THEN 'ANDROID' WHEN 3 THEN 'box' END AS fp FROM viewing) SELECT event_id, coalesce(device_type, CASE WHEN regexp_matches(lower(fp), 'tv|roku|apple_tv') THEN 'tv' WHEN regexp_matches(lower(fp), 'mobile|iphone|android') THEN 'mobile' ELSE 'tv' END) AS device FROM f")
def devices_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("k"), F.col("k").cast("string")
    fp = F.when(k % 5 == 0, F.concat(F.lit("Roku-"), text)).when(k % 5 == 1, F.concat(F.lit("iPhone-"), text)).when(k % 5 == 2, "ANDROID").when(k % 5 == 3, "box")
    return viewing_events(spark, sf_dir).select("event_id", m.device_by_fingerprint(F.when(k % 3 == 0, F.col("device_type")), fp).alias("device"))


@query("h09_merged_entities", f"""WITH {BASE}, e AS (SELECT account_id, device_id, count(*) AS session_count, sum(event_count) AS event_count, sum(conversion_value) AS conversion_value, 1.0 / (1 + count(*)) AS confidence, min(start_time) AS first_seen, max(end_time) AS last_seen FROM sessions GROUP BY ALL)
SELECT account_id, string_agg(DISTINCT device_id, ',' ORDER BY device_id) AS devices, CAST(sum(session_count) AS BIGINT) AS session_count, CAST(sum(event_count) AS BIGINT) AS event_count, round(sum(conversion_value), 4) AS conversion_value, round(sum(confidence * session_count) / sum(session_count), 6) AS confidence, epoch_us(min(first_seen)) AS first_seen, epoch_us(max(last_seen)) AS last_seen FROM e GROUP BY account_id""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0].groupBy("account_id", "device_id").agg(F.count("*").alias("session_count"), F.sum("event_count").alias("event_count"), F.sum("conversion_value").alias("conversion_value"), F.min("start_time").alias("first_seen"), F.max("end_time").alias("last_seen"))
    entities = made.withColumn("confidence", 1 / (1 + F.col("session_count"))).withColumn("devices", F.array("device_id"))
    merged = m.merged_entities(entities, "account_id")
    return merged.withColumns({"devices": F.array_join("devices", ","), "conversion_value": F.round("conversion_value", 4), "confidence": F.round("confidence", 6), "first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")})


@query("u05_channels_without_state", f"WITH {sql.JOURNEYS}, x AS (SELECT DISTINCT unnest(['START', 'CONVERSION', 'NULL', channel]) AS channel FROM journeys) SELECT channel FROM x WHERE channel NOT IN ('START', 'CONVERSION', 'NULL')")
def channels_without_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ("START", "CONVERSION", "NULL")
    every = read_table(spark, sf_dir, "orders").select(F.explode(F.array(*[F.lit(s) for s in states], F.col("o_orderpriority"))).alias("channel")).distinct()
    return every.where(~F.col("channel").isin(*states))


#: Profiles of neighbouring devices of an account, with stand-in address sets.
PROFILE_PAIRS = f"""WITH {BASE}, pr AS (SELECT device_id, any_value(account_id) AS account_id, avg(total_duration) AS dur, list_distinct(list(hour_of_day % 6)) AS ips FROM sessions GROUP BY device_id),
pairs AS (SELECT a.device_id AS a, b.device_id AS b, a.dur AS da, b.dur AS db, a.ips AS ia, b.ips AS ib FROM pr a JOIN pr b ON a.account_id = b.account_id AND a.device_id < b.device_id),
hd AS (SELECT device_id, hour_of_day, count(*) AS n FROM sessions GROUP BY ALL), hn AS (SELECT device_id, sqrt(sum(n * n)) AS norm FROM hd GROUP BY device_id),
hc AS (SELECT x.device_id AS a, y.device_id AS b, sum(x.n * y.n) AS dot FROM hd x JOIN hd y USING (hour_of_day) JOIN pairs ON x.device_id = a AND y.device_id = b GROUP BY 1, 2),
s AS (SELECT pairs.a, pairs.b, len(list_intersect(ia, ib)) / greatest(len(ia), len(ib)) AS ip, coalesce(dot, 0) / (na.norm * nb.norm) AS hour, CASE WHEN da > 0 AND db > 0 THEN least(da, db) / greatest(da, db) END AS ratio FROM pairs LEFT JOIN hc USING (a, b) JOIN hn na ON na.device_id = pairs.a JOIN hn nb ON nb.device_id = pairs.b)"""


@query("l08_profile_similarity", f"{PROFILE_PAIRS} SELECT a, b, round(ip, 6) AS ip, round((3 * ip + hour + coalesce(0.5 * ratio, 0)) / (4 + CASE WHEN ratio IS NULL THEN 0 ELSE 0.5 END), 6) AS similarity FROM s")
def profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of one account, compared by address sets, hours and session length (no genre signal here)."""
    made = both(spark, sf_dir)[0]
    profiles = made.groupBy("device_id").agg(F.min("account_id").alias("account_id"), F.avg("total_duration").alias("dur"), F.collect_set(F.col("hour_of_day") % 6).alias("ips"))
    hours = made.groupBy("device_id", "hour_of_day").agg(F.count("*").alias("n")).groupBy("device_id").agg(F.map_from_entries(F.collect_list(F.struct("hour_of_day", "n"))).alias("hours"))
    full = profiles.join(hours, "device_id")
    side = lambda s: full.select("account_id", *[F.col(x).alias(f"{s}_{x}") for x in ("device_id", "dur", "ips", "hours")])
    pairs = side("a").join(side("b"), "account_id").where("a_device_id < b_device_id")
    product = lambda x, y: F.aggregate(F.map_entries(x), F.lit(0.0), lambda t, kv: t + kv["value"] * F.coalesce(y[kv["key"]], F.lit(0)))
    cosine = product(F.col("a_hours"), F.col("b_hours")) / F.sqrt(product(F.col("a_hours"), F.col("a_hours")) * product(F.col("b_hours"), F.col("b_hours")))
    ip = m.overlap(F.col("a_ips"), F.col("b_ips"))
    score = m.profile_similarity(ip, cosine, F.lit(None).cast("double"), F.col("a_dur"), F.col("b_dur"))
    return pairs.select(F.col("a_device_id").alias("a"), F.col("b_device_id").alias("b"), F.round(ip, 6).alias("ip"), F.round(score, 6).alias("similarity"))


@query("b03_engagement_depth", f"WITH {BASE}, g AS (SELECT account_id, least(count(DISTINCT genre), 3) AS genres FROM genres GROUP BY account_id), n AS (SELECT account_id, count(*) AS n, sum(total_duration) / 3600 AS hours FROM sessions GROUP BY account_id) SELECT account_id, round(least(greatest((n * 0.2 + hours * 0.5 + genres * 0.3) / 3, 0.0), 1.0), 6) AS depth FROM n JOIN g USING (account_id)")
def engagement_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, genres = both(spark, sf_dir)
    told = genres.groupBy("account_id").agg(F.least(F.countDistinct("genre"), F.lit(3)).alias("genres"))
    counts = made.groupBy("account_id").agg(F.count("*").alias("n"), (F.sum("total_duration") / 3600).alias("hours"))
    return counts.join(told, "account_id").select("account_id", F.round(m.engagement_depth(F.col("n"), F.col("hours"), F.col("genres")), 6).alias("depth"))


@query("b04_hour_preferences", "SELECT persona, hour, CASE WHEN list_contains(liked, hour) THEN 0.3 ELSE 0.1 END AS weight FROM (VALUES ('primary_adult', [20, 21, 22, 23, 19]), ('secondary_adult', [18, 19, 20, 21, 14]), ('teen', [21, 22, 23, 0, 1]), ('child', [15, 16, 17, 10, 11])) t(persona, liked), (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour)")
def hour_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.preferences(spark).where("kind = 'hour'").select("persona", F.col("name").cast("int").alias("hour"), "weight")


#: Feedback on every third session: the device type said, which is right for most.
FEEDBACK = f"""WITH {PRED}, f AS (SELECT session_id AS id, account_id, device_type AS predicted, p, CAST(substr(account_id, length(account_id), 1) AS INTEGER) % 2 AS test, CASE WHEN hour(start_time) % 4 = 0 THEN 'tv' ELSE device_type END AS actual, CASE WHEN hour(start_time) % 2 = 0 THEN 'explicit' ELSE 'implicit' END AS kind FROM pred WHERE hour(start_time) % 3 = 0)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved predictions of every third hour: id, predicted, actual, kind, test, p, correct."""
    hour = F.hour("start_time")
    rows = predictions(spark, sf_dir).select(F.col("session_id").alias("id"), F.col("device_type").alias("predicted"), "p", "start_time", (F.substring("account_id", -1, 1).cast("int") % 2).alias("test"))
    said = predictions(spark, sf_dir).where(hour % 3 == 0).select(F.col("session_id").alias("id"), F.when(hour % 4 == 0, "tv").otherwise(F.col("device_type")).alias("actual"), F.when(hour % 2 == 0, "explicit").otherwise("implicit").alias("kind"))
    return e.resolved(rows, said)


@query("e02_resolved_feedback", f"{FEEDBACK} SELECT id, predicted, actual, kind, predicted = actual AS correct FROM f")
def resolved_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback(spark, sf_dir).select("id", "predicted", "actual", "kind", "correct")


@query("e04_test_results", f"{FEEDBACK} SELECT test, kind, count(*) AS n, count(CASE WHEN predicted = actual THEN 1 END) AS n_correct, round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(p), 6) AS confidence FROM f GROUP BY test, kind")
def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e.test_results(feedback(spark, sf_dir), "test", "kind"), "accuracy", "confidence")


@query("e07_decile_report", f"WITH {PRED}, b AS (SELECT floor(p * 10) / 10 AS bin, count(*) AS n, avg(y) AS accuracy FROM pred GROUP BY 1) SELECT bin, n, round(accuracy, 6) AS accuracy, round(abs(bin - accuracy), 6) AS error FROM b")
def decile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e.decile_report(predictions(spark, sf_dir)), "accuracy", "error")


@query("e14_calibration_score", f"WITH {PRED}, {BINS} SELECT round(least(greatest(1 - (SELECT avg(abs(bin - rate)) FROM bins), 0.0), 1.0), 6) AS score, round((SELECT avg(abs(p - y)) FROM pred), 6) AS mae")
def calibration_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(e.calibration_score(predictions(spark, sf_dir)), "score", "mae")


@query("e16_assignment_lift", f"""WITH {BASE}, f AS (SELECT account_id, arg_min(device_type, (-n, device_type)) AS first_member FROM (SELECT account_id, device_type, count(*) AS n FROM sessions GROUP BY ALL) GROUP BY account_id),
x AS (SELECT s.device_type AS truth, first_member, CASE WHEN hour_of_day % 5 = 0 THEN 'tv' ELSE s.device_type END AS guess FROM sessions s JOIN f USING (account_id)), a AS (SELECT avg(CASE WHEN guess = truth THEN 1.0 ELSE 0.0 END) AS ma, avg(CASE WHEN first_member = truth THEN 1.0 ELSE 0.0 END) AS ba FROM x)
SELECT round(ma, 6) AS model_accuracy, round(ba, 6) AS baseline_accuracy, round(CASE WHEN ba > 0 THEN ma / ba - 1 ELSE 0.0 END, 6) AS lift FROM a""")
def assignment_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = both(spark, sf_dir)[0]
    first = made.groupBy("account_id", "device_type").agg(F.count("*").alias("n")).groupBy("account_id").agg(F.min_by("device_type", F.struct(-F.col("n"), F.col("device_type"))).alias("first_member"))
    guess = F.when(F.col("hour_of_day") % 5 == 0, "tv").otherwise(F.col("device_type"))
    return rounded(e.lift(made.join(first, "account_id").withColumn("guess", guess), "guess", "first_member", "device_type"), "model_accuracy", "baseline_accuracy", "lift")


@query("dr01_baselines", f"WITH {BASE} SELECT account_id, count(*) AS n, round(avg(CASE WHEN day_of_week >= 5 THEN 1.0 ELSE 0.0 END), 6) AS weekend, round(avg(hour_of_day), 6) AS mean_hour, round(avg(total_duration), 6) AS mean_duration FROM sessions GROUP BY account_id HAVING count(*) >= 20")
def account_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.baselines(both(spark, sf_dir)[0], "account_id", 20), "weekend", "mean_hour", "mean_duration")


@query("dr04_confidence_drop", f"WITH {PRED}, x AS (SELECT device_type, avg(CASE WHEN day(start_time) <= 15 THEN p END) AS b, avg(CASE WHEN day(start_time) > 15 THEN p * 0.5 END) AS c FROM pred GROUP BY device_type) SELECT device_type, round(b - c, 6) AS drop, round(CASE WHEN b - c > 0.2 THEN least((b - c) * 2, 1.0) ELSE 0.0 END, 6) AS severity FROM x WHERE b IS NOT NULL AND c IS NOT NULL")
def confidence_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, day = predictions(spark, sf_dir), F.dayofmonth("start_time")
    return rounded(d.confidence_drop(rows.where(day <= 15), rows.where(day > 15).withColumn("p", F.col("p") * 0.5), "device_type", "p"), "drop", "severity")


@query("dr11_quick_shift", f"WITH {BASE}, x AS (SELECT account_id, avg(CASE WHEN day(start_time) <= 15 THEN hour_of_day END) AS b, count(CASE WHEN day(start_time) <= 15 THEN 1 END) AS nb, avg(CASE WHEN day(start_time) > 15 THEN hour_of_day END) AS c, count(CASE WHEN day(start_time) > 15 THEN 1 END) AS nc FROM sessions GROUP BY account_id) SELECT account_id, round(least(abs(c - b), 24 - abs(c - b)), 6) AS shift, least(abs(c - b), 24 - abs(c - b)) > 3 AS shifted FROM x WHERE nb >= 10 AND nc >= 10")
def quick_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, day = both(spark, sf_dir)[0], F.dayofmonth("start_time")
    return rounded(d.quick_shift(made.where(day <= 15), made.where(day > 15), "account_id"), "shift")


@query("dr15_holdout", f"WITH {BASE}, r AS (SELECT account_id, session_id, row_number() OVER (PARTITION BY account_id ORDER BY start_time DESC, session_id DESC) AS nth FROM sessions) SELECT account_id, session_id FROM r WHERE nth <= 10")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.holdout(both(spark, sf_dir)[0], "account_id", ["start_time", "session_id"], 10).select("account_id", "session_id")


@query("dr16_regime_metrics", f"WITH {GIVEN}, b AS (SELECT session_id, label, arg_min(cluster, (round(dist, 9), cluster)) AS cluster, min(dist) AS dist FROM d GROUP BY ALL), c AS (SELECT label, 1 / (1 + dist) AS sure, CASE WHEN cluster = label THEN 1.0 ELSE 0.0 END AS ok FROM b) SELECT label, count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(sure), 6) AS confidence, round(avg(pow(sure - ok, 2)), 6) AS brier FROM c GROUP BY label HAVING count(*) >= 20")
def regime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = points(spark, sf_dir)
    assigned = c.nearest(rows, centroids, ["g"]).select("session_id", "cluster", "distance").join(rows.select("session_id", F.col("true_person").alias("label")), "session_id")
    return rounded(d.regime_metrics(assigned, "label", "cluster", "label", "distance"), "accuracy", "confidence", "brier")


@query("i08_radial_probabilities", f"WITH {GIVEN}, w AS (SELECT session_id, cluster, exp(-pow(dist, 2) / (2 * pow(0.5 + 0.25 * cluster, 2))) AS w FROM d) SELECT session_id, cluster, round(CASE WHEN sum(w) OVER s > 0 THEN w / sum(w) OVER s ELSE 1.0 / count(*) OVER s END, 6) AS p FROM w WINDOW s AS (PARTITION BY session_id)")
def radial_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four given centroids, sent to all tasks: a session's four distances are made where it is read."""
    rows, centroids = points(spark, sf_dir)
    apart = F.sqrt(F.aggregate(F.zip_with("features", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    distances = rows.join(F.broadcast(centroids), "g").select("session_id", "cluster", apart.alias("distance"), (0.5 + 0.25 * F.col("cluster")).alias("radius"))
    return c.radial_probabilities(distances, "session_id").withColumn("p", F.round("p", 6))


@query("i10_idle_clusters", f"WITH {BASE}, x AS (SELECT device_id, max(end_time) AS seen FROM sessions GROUP BY device_id) SELECT device_id, epoch_us((SELECT max(seen) FROM x)) - epoch_us(seen) > 604800000000 AS expired FROM x")
def idle_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = both(spark, sf_dir)[0].groupBy("device_id").agg(F.max("end_time").alias("seen"))
    now = seen.agg(F.max("seen").alias("now")).withColumn("one", F.lit(1))
    return c.idle_clusters(seen.withColumn("one", F.lit(1)).join(F.broadcast(now), "one"), "seen", F.col("now")).select("device_id", "expired")


@query("m02_session_paths", f"WITH {BASE} SELECT account_id, string_agg(first_channel, '>' ORDER BY start_time, session_id) AS path, bool_or(conversion_value > 0) AS converted FROM sessions GROUP BY account_id")
def session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = both(spark, sf_dir)[0].groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "session_id", "first_channel"))).alias("x"), F.bool_or(F.col("conversion_value") > 0).alias("converted"))
    return grouped.select("account_id", F.array_join(F.transform("x", lambda s: s["first_channel"]), ">").alias("path"), "converted")


@query("q02_lambda_sweep", f"WITH {sql.JOURNEYS}, w AS (SELECT *, CASE WHEN channel = '1-URGENT' THEN 1.5 WHEN channel = '5-LOW' THEN 0.5 ELSE 1.0 END AS w FROM journeys), l AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0]) AS strength), x AS (SELECT strength, channel, sum(1 + strength * (w - 1)) AS amount FROM w, l GROUP BY ALL) SELECT CAST(strength AS DOUBLE) AS strength, channel, round(amount / sum(amount) OVER (PARTITION BY strength), 8) AS share FROM x")
def lambda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"1-URGENT": 1.5, "5-LOW": 0.5}
    counts = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("channel")).agg(F.count("*").alias("n"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")], F.lit(1.0))
    return u.lambda_sweep(counts.withColumn("weight", weight)).withColumn("share", F.round("share", 8))


@query("dr02_strongest_signal", f"""WITH {BASE}, s AS (SELECT account_id, 'COMPOSITION_SHIFT' AS signal, count(DISTINCT device_type) / 8.0 AS severity FROM sessions GROUP BY account_id UNION ALL SELECT account_id, 'TEMPORAL', round(avg(hour_of_day), 6) / 24 FROM sessions GROUP BY account_id UNION ALL SELECT account_id, 'VOLUME', CASE WHEN count(*) < 50 THEN 0.9 ELSE 0.0 END FROM sessions GROUP BY account_id)
SELECT account_id, arg_min(signal, (-severity, signal)) AS signal, round(max(severity), 6) AS severity, max(severity) >= 0.7 OR starts_with(arg_min(signal, (-severity, signal)), 'COMPOSITION') AS recluster FROM s WHERE severity > 0 GROUP BY account_id""")
def strongest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = both(spark, sf_dir)[0].groupBy("account_id").agg((F.countDistinct("device_type") / 8.0).alias("COMPOSITION_SHIFT"), (F.round(F.avg("hour_of_day"), 6) / 24).alias("TEMPORAL"), F.when(F.count("*") < 50, 0.9).otherwise(0.0).alias("VOLUME"))
    signals = by.unpivot("account_id", ["COMPOSITION_SHIFT", "TEMPORAL", "VOLUME"], "signal", "severity")
    return d.strongest(signals, "account_id").withColumn("severity", F.round("severity", 6))


@query("dr14_newest_snapshots", f"WITH {BASE}, s AS (SELECT device_type, CAST(start_time AS DATE) AS day, count(*) AS n FROM sessions GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY device_type ORDER BY day DESC) AS nth FROM s) SELECT device_type, CAST(day AS VARCHAR) AS day, n FROM r WHERE nth <= 5")
def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = both(spark, sf_dir)[0].groupBy("device_type", F.to_date("start_time").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return d.newest_snapshots(snapshots, "device_type", "day")


@query("dr17_rollback", f"WITH {PRED}, x AS (SELECT account_id, avg(CASE WHEN day(start_time) <= 15 THEN pow(p - y, 2) END) AS b0, avg(CASE WHEN day(start_time) > 15 THEN pow(p - y, 2) END) AS b1, avg(CASE WHEN day(start_time) <= 15 THEN y END) AS a0, avg(CASE WHEN day(start_time) > 15 THEN y END) AS a1 FROM pred GROUP BY account_id) SELECT account_id, round(b1 - b0, 9) > 0.15 OR round(a0 - a1, 9) > 0.1 AS roll_back FROM x WHERE b0 IS NOT NULL AND b1 IS NOT NULL")
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, error = F.dayofmonth("start_time") <= 15, F.pow(F.col("p") - F.col("y"), 2)
    of = lambda x, when: F.round(F.avg(F.when(when, x)), 12)
    made = predictions(spark, sf_dir).groupBy("account_id").agg(of(error, first).alias("base_brier"), of(error, ~first).alias("brier"), of(F.col("y"), first).alias("base_accuracy"), of(F.col("y"), ~first).alias("accuracy"))
    return d.should_roll_back(made.where("base_brier IS NOT NULL AND brier IS NOT NULL")).select("account_id", "roll_back")


@query("e15_overall_score", f"WITH {PRED}, x AS (SELECT device_type, avg(y) AS a, avg(p) AS b FROM pred GROUP BY device_type) SELECT device_type, round(0.15 * a + 0.35 * b + 0.25 * (1 - a) + 0.25 * (1 - abs(a - b)), 6) AS score FROM x")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = predictions(spark, sf_dir).groupBy("device_type").agg(F.avg("y").alias("a"), F.avg("p").alias("b"))
    return made.select("device_type", F.round(e.overall_score(F.col("a"), F.col("b"), 1 - F.col("a"), 1 - F.abs(F.col("a") - F.col("b"))), 6).alias("score"))


@query("r09_accuracy_trend", f"WITH {PRED}, w AS (SELECT day(start_time) AS day, round(avg(y), 6) AS accuracy FROM pred GROUP BY 1), l AS (SELECT *, lag(accuracy, 2) OVER (ORDER BY day) AS before FROM w) SELECT CAST(day AS INTEGER) AS day, accuracy, CASE WHEN before IS NULL THEN 'unknown' WHEN accuracy > before + 0.02 THEN 'improving' WHEN accuracy < before - 0.02 THEN 'degrading' ELSE 'stable' END AS trend FROM l")
def accuracy_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per day of the month: 31 windows at most are ordered in one task."""
    windows = predictions(spark, sf_dir).groupBy(F.dayofmonth("start_time").alias("day")).agg(F.round(F.avg("y"), 6).alias("accuracy"))
    return e.trend(windows, "day", "accuracy")


@query("p19_time_labels", f"WITH {BASE}, x AS (SELECT device_id, round(avg(hour_of_day), 6) AS h FROM sessions GROUP BY device_id) SELECT device_id, CASE WHEN h >= 5 AND h <= 11.999999 THEN 'Morning' WHEN h >= 12 AND h < 17 THEN 'Afternoon' WHEN h >= 17 AND h < 21 THEN 'Evening' ELSE 'Night Owl' END AS label FROM x")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir)[0].groupBy("device_id").agg(F.round(F.avg("hour_of_day"), 6).alias("h")).select("device_id", p.time_label(F.col("h")).alias("label"))


@query("i09_distance_drift", f"WITH {GIVEN}, b AS (SELECT session_id, label, round(min(dist), 6) AS dist FROM d GROUP BY ALL), w AS (SELECT session_id, label, avg(dist) OVER (PARTITION BY label ORDER BY session_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last, avg(dist) OVER s AS mean, stddev_pop(dist) OVER s AS spread FROM b WINDOW s AS (PARTITION BY label ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT session_id, label, CASE WHEN spread > 1e-9 THEN abs(last - mean) / spread ELSE 0.0 END > 2.0 AS drifted FROM w")
def distance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = points(spark, sf_dir)
    assigned = c.nearest(rows, centroids, ["g"]).select("session_id", F.round("distance", 6).alias("distance")).join(rows.select("session_id", F.col("true_person").alias("label")), "session_id")
    return c.drift_scores(assigned, "label", "session_id").select("session_id", "label", (F.col("z") > 2.0).alias("drifted"))


@query("p05_session_duplicates", f"WITH {BASE}, x AS (SELECT substr(session_id, 1, 3) AS prefix FROM sessions) SELECT prefix, count(*) AS n FROM x GROUP BY prefix HAVING count(*) > 1")
def session_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids cut to three characters, so that some clash."""
    return v.duplicates(both(spark, sf_dir)[0].select(F.substring("session_id", 1, 3).alias("prefix")), "prefix")


@query("p06_household_validation", f"""WITH {BASE}, x AS (SELECT account_id, count(DISTINCT device_id) AS devices, CAST(account_id AS BIGINT) AS a FROM sessions GROUP BY account_id),
h AS (SELECT account_id, CASE WHEN a % 7 = 0 THEN 0 WHEN a % 7 = 1 THEN 21 ELSE devices END AS size, CASE WHEN a % 5 = 0 THEN 1.5 ELSE 0.5 END AS confidence, devices FROM x)
SELECT account_id, concat_ws(',', CASE WHEN size < 1 THEN 'size_below_one' END, CASE WHEN size > 20 THEN 'size_above_twenty' END, CASE WHEN confidence > 1 THEN 'confidence_range' END, CASE WHEN devices <> size THEN 'member_count' END) AS errors FROM h""")
def household_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = m.equal_split(member_rows(spark, sf_dir)[0].withColumnRenamed("device_id", "person_id"), "account_id")
    number = F.col("account_id").cast("long")
    found = members.groupBy("account_id").agg(F.count("*").alias("n_devices"))
    told = found.withColumns({"size": F.when(number % 7 == 0, 0).when(number % 7 == 1, 21).otherwise(F.col("n_devices")), "confidence": F.when(number % 5 == 0, 1.5).otherwise(0.5)})
    return v.validate_households(told, members).select("account_id", F.array_join("errors", ",").alias("errors"))


@query("p07_device_distributions", f"WITH {BASE}, x AS (SELECT device_id, hour_of_day, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY device_id) AS share FROM sessions GROUP BY device_id, hour_of_day) SELECT device_id, round(abs(sum(share) - 1), 9) <= 0.1 AS is_valid FROM x WHERE hour_of_day <> 3 GROUP BY device_id")
def device_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by hour, of which one hour's are left out, so that some devices fail."""
    shares = p.distribution(both(spark, sf_dir)[0], ["device_id"], "hour_of_day").where("hour_of_day != 3")
    return v.validate_distribution(shares.withColumn("share", F.round("share", 12)), ["device_id"], "share")


@query("p21_scope", f"WITH {sql.VIEWING} SELECT event_id FROM viewing WHERE account_id = '7' AND device_id IN ('7-1', '7-2') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = viewing_events(spark, sf_dir)
    at = lambda day: F.lit(day).cast("timestamp")
    return events.where(privacy.in_scope(events, "7", ["7-1", "7-2"], at("2024-01-05"), at("2024-01-25"))).select("event_id")


@query("e03_confirmed_by_later_sessions", f"WITH {BASE}, s AS (SELECT *, CASE WHEN CAST(account_id AS BIGINT) % 2 = 0 THEN device_id ELSE account_id END AS a FROM sessions), l AS (SELECT x.session_id AS id, count(*) AS n, count(DISTINCT y.device_id) AS devices FROM s x JOIN s y USING (a) WHERE epoch_us(y.start_time) - epoch_us(x.start_time) >= 86400000000 GROUP BY 1) SELECT id FROM l WHERE n >= 3 AND devices = 1")
def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of even accounts stand for accounts of one device each."""
    made = both(spark, sf_dir)[0]
    made = made.withColumn("account_id", F.when(F.col("account_id").cast("long") % 2 == 0, F.col("device_id")).otherwise(F.col("account_id")))
    return e.implicit_feedback(made.select(F.col("session_id").alias("id"), "account_id", F.col("start_time").alias("at")), made)


@query("v12_tampered_chain", f"WITH {sql.VIEWING} SELECT CAST(count(*) AS INTEGER) AS broken FROM viewing WHERE event_id % 50 = 7")
def tampered_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth record is changed after the log was chained: exactly those no longer match their hash."""
    log = privacy.chained(audit_log(spark, sf_dir))
    changed = log.withColumn("resource", F.when(F.col("seq") % 50 == 7, F.concat(F.lit("x"), "resource")).otherwise(F.col("resource")))
    return privacy.broken_links(changed).agg(F.count("*").cast("int").alias("broken"))
