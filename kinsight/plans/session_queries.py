"""Queries over sessions, features and profiles, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinsight.functions import features as fx
from kinsight.operators import sessions as ops
from kinsight.plans import sql
from kinsight.plans.registry import query
from kinsight.sources.views import viewing_events
from kinsight.vocabulary import DEVICE_TYPES, GENRES

KEYS = ["account_id", "device_id", "session_no"]


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _session_query(gap: int, keys: tuple[str, ...]):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = ops.sessions(viewing_events(spark, sf_dir), gap, keys)
        return rounded(made, ["total_duration", "conversion_value"]).select("session_id", *keys, F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_count", "total_duration", "device_type", "first_channel", "conversion_value", "n_channels", "hour_of_day", "day_of_week")

    return build


for _gap, _keys, _name in ((30, ("account_id", "device_id"), "w01_sessions_30"), (480, ("account_id", "device_id"), "w01_sessions_480"), (480, ("account_id",), "w01_account_sessions_480")):
    query(_name, f"""WITH {sql.sessions(_gap, _keys)}
SELECT session_id, {', '.join(_keys)}, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS started, event_count, round(total_duration, 6) AS total_duration, device_type, first_channel,
  round(conversion_value, 6) AS conversion_value, n_channels, hour_of_day, day_of_week FROM sessions""")(_session_query(_gap, _keys))


@query("w02_primary_genre", f"""WITH {sql.sessions(480)}
SELECT session_id, arg_min(genre, (-seconds, genre)) AS primary_genre, count(*) AS n_genres FROM sessions JOIN genres USING (account_id, device_id, session_no) GROUP BY session_id""")
def primary_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = viewing_events(spark, sf_dir)
    genres = ops.session_genres(events, 480)
    counts = genres.groupBy(*KEYS).agg(F.count("*").alias("n_genres"))
    return ops.with_primary_genre(ops.sessions(events, 480), genres).join(counts, KEYS).select("session_id", "primary_genre", "n_genres")


@query("x03_session_window", f"""WITH {sql.sessions(30)}
SELECT account_id, device_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS started, event_count, round(total_duration, 6) AS total_duration FROM sessions""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ops.window_sessions(viewing_events(spark, sf_dir), 30)
    return made.select("account_id", "device_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_count", F.round("total_duration", 6).alias("total_duration"))


def _cyc(expr: str, period: int, name: str) -> str:
    return f"sin({expr} * (2 * pi() / {period})) AS {name}_sin, cos({expr} * (2 * pi() / {period})) AS {name}_cos"


@query("f01_event_features", f"""WITH {sql.VIEWING}, f AS (
SELECT event_id, {_cyc('hour(ts)', 24, 'hour')}, {_cyc('(isodow(ts) - 1)', 7, 'day')}, ln(1 + duration_sec) AS duration_log,
  {', '.join(f"CASE WHEN device_type = '{d}' THEN 1.0 ELSE 0.0 END AS device_{d}" for d in DEVICE_TYPES)}, 0.0 AS device_unknown FROM viewing)
SELECT event_id, {', '.join(f"round({n}, 6) + 0.0 AS {n}" for n in ['hour_sin', 'hour_cos', 'day_sin', 'day_cos', 'duration_log'])},
  {', '.join(f"CAST(device_{d} AS DOUBLE) AS device_{d}" for d in [*DEVICE_TYPES, 'unknown'])} FROM f""")
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.event_features(viewing_events(spark, sf_dir))
    return made.withColumns({n: F.round(n, 6) + 0.0 for n in ["hour_sin", "hour_cos", "day_sin", "day_cos", "duration_log"]})


CLUSTER_SQL = f"""{sql.sessions(480)}, shares AS (
  SELECT account_id, device_id, session_no, {', '.join(f"sum(CASE WHEN genre = '{g}' THEN seconds ELSE 0.0 END) AS g_{g.lower()}" for g in GENRES)} FROM genres GROUP BY 1, 2, 3),
feats AS (
  SELECT account_id, session_id, {_cyc('hour_of_day', 24, 'hour')}, {_cyc('day_of_week', 7, 'day')}, CASE WHEN day_of_week >= 5 THEN 1.0 ELSE 0.0 END AS is_weekend,
    {', '.join(f"CASE WHEN device_type = '{d}' THEN 1.0 ELSE 0.0 END AS device_{d}" for d in DEVICE_TYPES)},
    {', '.join(f"CASE WHEN total_duration > 0 THEN g_{g.lower()} / total_duration ELSE 0.0 END AS genre_{g.lower()}" for g in GENRES)},
    ln(1 + total_duration / 60) AS duration_log, CASE WHEN total_duration > 0 THEN event_count / (total_duration / 60) ELSE 0.0 END AS event_density
  FROM sessions JOIN shares USING (account_id, device_id, session_no))"""


@query("f03_cluster_features", f"""WITH {CLUSTER_SQL}
SELECT session_id, {', '.join(f"CAST(round({n}, 6) + 0.0 AS DOUBLE) AS {n}" for n in fx.CLUSTER_FEATURES)} FROM feats""")
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = viewing_events(spark, sf_dir)
    made = fx.cluster_features(ops.sessions(events, 480), ops.session_genres(events, 480), KEYS)
    return made.select("session_id", *[(F.round(n, 6) + 0.0).alias(n) for n in fx.CLUSTER_FEATURES])


@query("f05_normalised_features", f"""WITH {CLUSTER_SQL}, z AS (SELECT session_id,
  {', '.join(f"({n} - avg({n}) OVER w) / CASE WHEN stddev_pop({n}) OVER w = 0 THEN 1.0 ELSE stddev_pop({n}) OVER w END * {fx.weight(n)} AS {n}" for n in ['hour_sin', 'day_cos', 'device_tv', 'genre_kids', 'duration_log'])}
  FROM feats WINDOW w AS (PARTITION BY account_id))
SELECT session_id, {', '.join(f"CAST(round({n}, 4) + 0.0 AS DOUBLE) AS {n}" for n in ['hour_sin', 'day_cos', 'device_tv', 'genre_kids', 'duration_log'])} FROM z""")
def normalised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = viewing_events(spark, sf_dir)
    made = fx.normalised(fx.cluster_features(ops.sessions(events, 480), ops.session_genres(events, 480), KEYS), "account_id")
    return made.select("session_id", *[(F.round(n, 4) + 0.0).alias(n) for n in ["hour_sin", "day_cos", "device_tv", "genre_kids", "duration_log"]])


@query("f08_device_fingerprints", f"""WITH {sql.VIEWING}
SELECT DISTINCT device_id, substr(sha256(lower(device_type) || '|' || lower('OS' || (k % 4)) || '|unknown|1920x1080'), 1, 16) AS fingerprint FROM viewing""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.device_fingerprint(F.col("device_type"), F.concat(F.lit("OS"), (F.col("k") % 4).cast("string")), F.lit("unknown"), F.lit("1920x1080"))
    return viewing_events(spark, sf_dir).select("device_id", made.alias("fingerprint")).distinct()


@query("r07_rolling_distance", f"""WITH {sql.VIEWING}, m AS (
SELECT event_id, avg(duration_sec) OVER w AS rolling_mean, stddev_pop(duration_sec) OVER w AS rolling_std FROM viewing WINDOW w AS (PARTITION BY account_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, round(rolling_mean, 6) AS rolling_mean, round(rolling_std, 4) AS rolling_std FROM m""")
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("account_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return viewing_events(spark, sf_dir).select("event_id", F.round(F.avg("duration_sec").over(last), 6).alias("rolling_mean"), F.round(F.stddev_pop("duration_sec").over(last), 4).alias("rolling_std"))
