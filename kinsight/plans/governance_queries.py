"""Queries over privacy, audit and segments, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.operators import privacy as v
from kinsight.operators import segments as s
from kinsight.operators import sessions as ops
from kinsight.plans import sql
from kinsight.plans.profile_queries import BASE, both, persona_sql
from kinsight.plans.registry import query
from kinsight.sources.views import viewing_events
from kinsight.vocabulary import BASE_INTENT, PRICE_SENSITIVITY, SEGMENTS

GONE = "((account_id = '1') OR (account_id = '2' AND device_id = '2-1') OR (account_id = '3' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'))"


def requests(spark: SparkSession) -> DataFrame:
    rows = [("1", None, None, None), ("2", "2-1", None, None), ("3", None, "2024-01-10", "2024-01-20")]
    return spark.createDataFrame(rows, "account_id string, device_id string, f string, t string").select("account_id", "device_id", F.col("f").cast("timestamp").alias("from_ts"), F.col("t").cast("timestamp").alias("to_ts"))


@query("v04_events_kept", f"WITH {sql.VIEWING} SELECT event_id, account_id, device_id FROM viewing WHERE NOT {GONE}")
def events_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.deletion(viewing_events(spark, sf_dir), requests(spark))[0].select("event_id", "account_id", "device_id")


@query("v05_rebuilt_sessions", f"WITH {sql.sessions(480).replace('FROM viewing)', f'FROM viewing WHERE NOT {GONE})', 1)} SELECT session_id, event_count, round(total_duration, 6) AS total_duration FROM sessions WHERE event_count >= 2")
def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = v.deletion(viewing_events(spark, sf_dir), requests(spark))[0]
    return v.rebuilt_sessions(ops.sessions(kept, 480)).select("session_id", "event_count", F.round("total_duration", 6).alias("total_duration"))


@query("a16_deletion_summary", f"WITH {sql.VIEWING} SELECT account_id, count(*) AS events, count(DISTINCT device_id) AS devices, round(sum(duration_sec), 4) AS duration FROM viewing WHERE {GONE} GROUP BY account_id")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.deletion_summary(v.deletion(viewing_events(spark, sf_dir), requests(spark))[1]).withColumn("duration", F.round("duration", 4))


@query("v08_retention", f"WITH {sql.VIEWING} SELECT event_id FROM viewing WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.retained(viewing_events(spark, sf_dir), "ts", F.lit("2024-02-01").cast("timestamp"), 10).select("event_id")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewing events as an audit log: one chain per device type."""
    e = viewing_events(spark, sf_dir)
    return e.select(F.col("device_type").alias("chain"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.col("account_id").alias("actor"), F.lit("view").alias("event_type"), F.col("genre").alias("resource"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))


ROW = """'{"action": "' || action || '", "actor": "' || actor || '", "event_type": "view", "previous_hash": "' || h || '", "resource": "' || resource || '", "seq": ' || l.seq || ', "ts": "' || ts || '"}'"""


@query("v09_audit_chain", f"""WITH RECURSIVE {sql.VIEWING}, l AS (SELECT device_type AS chain, event_id AS seq, event_type AS action, account_id AS actor, genre AS resource, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, row_number() OVER (PARTITION BY device_type ORDER BY event_id) AS n FROM viewing),
c AS (SELECT chain, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, '{"0" * 64}' AS h FROM (SELECT DISTINCT chain FROM l) UNION ALL SELECT l.chain, l.n, l.seq, sha256({ROW}) FROM c JOIN l ON l.chain = c.chain AND l.n = c.n + 1)
SELECT chain, seq, h AS event_hash FROM c WHERE n > 0""")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.chained(log(spark, sf_dir)).select("chain", "seq", "event_hash")


@query("v12_chain_verification", "SELECT 0 AS broken")
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.broken_links(v.chained(log(spark, sf_dir))).agg(F.count("*").cast("int").alias("broken"))


@query("v11_busy_actors", f"WITH {sql.VIEWING}, r AS (SELECT event_id, channel AS actor, count(*) OVER (PARTITION BY channel ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM viewing) SELECT * FROM r WHERE recent > 8")
def busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = viewing_events(spark, sf_dir).select("event_id", F.col("channel").alias("actor"), "ts")
    return v.busy_actors(e, 8).select("event_id", "actor", "recent")


def case(values: dict[str, float], default: float) -> str:
    return "CASE persona " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in values.items()) + f" ELSE {default} END"


PERSONS = f"""{BASE}, {persona_sql('device_id')}, t AS (SELECT device_id, count(*) AS sessions, sum(total_duration) / 3600 AS hours, sum(conversion_value) AS value FROM sessions GROUP BY 1), ng AS (SELECT device_id, least(count(DISTINCT genre), 3) AS n_genres FROM genres GROUP BY 1),
e AS (SELECT device_id, persona, value, least(greatest((0.3 * sessions + 0.5 * hours + 0.2 * n_genres) / 3, 0.0), 1.0) AS engagement FROM personas JOIN t USING (device_id) JOIN ng USING (device_id)),
persons AS (SELECT *, least(greatest({case(BASE_INTENT, 0.5)} + (engagement - 0.5) * 0.3, 0.0), 1.0) AS intent, {case(PRICE_SENSITIVITY, 0.5)} AS price_sensitivity FROM e),
templates AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {sql.listed(p) if p else 'NULL'}, {i})" for k, (p, i, *_) in SEGMENTS.items())}) x(segment, personas, least_intent)),
efficacy AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{c}', {x})" for k, v_ in SEGMENTS.items() for c, x in v_[3].items())}) x(segment, channel, efficacy)),
seg AS (SELECT segment, persona, count(*) AS size, avg(value) AS average_value, avg(intent) AS mean_intent, count(*) / (SELECT count(*) FROM persons) AS share FROM persons JOIN templates ON intent >= least_intent AND (personas IS NULL OR list_contains(personas, persona)) GROUP BY ALL)"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.operators.profiles import personas

    made, genres = both(spark, sf_dir)
    told = personas(made, genres, "device_id").select("device_id", "persona")
    sums = made.groupBy("device_id").agg(F.count("*").alias("sessions"), (F.sum("total_duration") / 3600).alias("hours"), F.sum("conversion_value").alias("value"))
    liked = genres.groupBy("device_id").agg(F.least(F.countDistinct("genre"), F.lit(3)).alias("n_genres"))
    return s.enriched(told.join(sums, "device_id").join(liked, "device_id").withColumn("household_size", F.lit(4)))


@query("b01_person_metrics", f"WITH {PERSONS} SELECT device_id, persona, round(engagement, 6) AS engagement, round(intent, 6) AS intent, CAST(price_sensitivity AS DOUBLE) AS price_sensitivity FROM persons")
def person_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persons(spark, sf_dir).select("device_id", "persona", F.round("engagement", 6).alias("engagement"), F.round("intent", 6).alias("intent"), "price_sensitivity")


@query("b06_segments", f"WITH {PERSONS} SELECT segment, persona, size, round(average_value, 6) AS average_value, round(mean_intent, 6) AS mean_intent, round(share, 6) AS share FROM seg")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.segments(persons(spark, sf_dir)).withColumns({n: F.round(n, 6) for n in ("average_value", "mean_intent", "share")})


@query("b07_channel_attribution", f"WITH {PERSONS} SELECT channel, round(sum(share * efficacy), 6) AS attributed FROM seg JOIN efficacy USING (segment) GROUP BY channel")
def channel_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.channel_attribution(s.segments(persons(spark, sf_dir))).withColumn("attributed", F.round("attributed", 6))


@query("b08_recommendations", f"WITH {PERSONS}, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY efficacy DESC, channel) AS rank FROM efficacy) SELECT segment, channel, rank, round(efficacy / sum(efficacy) OVER (PARTITION BY segment), 6) AS budget FROM r WHERE rank <= 3")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.recommendations(spark).select("segment", "channel", "rank", F.round("budget", 6).alias("budget"))
