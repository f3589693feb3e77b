"""SQL of the inputs and sessions that the oracles share."""

from kinsight.vocabulary import CHANNELS, DEVICE_TYPES, GENRES


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWING = f"""viewing AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS account_id, user_id || '-' || (k % 4) AS device_id, ts, event_type,
    ({listed(DEVICE_TYPES)})[k % 4 + 1] AS device_type, ({listed(GENRES)})[k // 10 + 1] AS genre, ({listed(CHANNELS)})[k % 6 + 1] AS channel,
    value AS duration_sec, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS conversion_value, k
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def sessions(gap_minutes: int = 30, keys: tuple[str, ...] = ("account_id", "device_id")) -> str:
    """CTEs viewing, numbered, sessions, genres."""
    by, micros = ", ".join(keys), gap_minutes * 60_000_000
    joined = " || '_' || ".join(keys)
    return f"""{VIEWING}, gaps AS (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {by} ORDER BY ts, event_id) AS gap FROM viewing),
numbered AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > CAST({micros} AS BIGINT) THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY ts, event_id) AS session_no FROM gaps),
made AS (
  SELECT {by}, session_no, min(ts) AS start_time, max(ts) AS end_time, count(*) AS event_count, sum(duration_sec) AS total_duration,
    arg_min(device_type, (ts, event_id)) AS device_type, arg_min(channel, (ts, event_id)) AS first_channel,
    sum(CASE WHEN conversion_value > 0 THEN conversion_value ELSE 0.0 END) AS conversion_value, count(DISTINCT channel) AS n_channels
  FROM numbered GROUP BY {by}, session_no),
sessions AS (
  SELECT *, substr(md5({joined} || '_' || strftime(start_time, '%Y-%m-%d %H:%M:%S')
      || CASE WHEN epoch_us(start_time) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(start_time) % 1000000 AS VARCHAR), 6, '0') END), 1, 16) AS session_id,
    CAST(hour(start_time) AS INTEGER) AS hour_of_day, CAST(isodow(start_time) - 1 AS INTEGER) AS day_of_week FROM made),
genres AS (SELECT {by}, session_no, genre, sum(duration_sec) AS seconds FROM numbered GROUP BY {by}, session_no, genre)"""


JOURNEYS = """journeys AS (
  SELECT o_custkey AS person, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, o_orderpriority AS channel,
    last_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 'F' AS converted,
    sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) OVER (PARTITION BY o_custkey) AS value
  FROM orders)"""
