"""Queries over clustering and assignment, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.functions import features as fx
from kinsight.operators import clustering as c
from kinsight.operators import sessions as ops
from kinsight.plans.registry import query
from kinsight.plans.session_queries import KEYS
from kinsight.sources.views import vectors, viewing_events

# Four given centroids: the vectors 0 to 3.
GIVEN = """v AS (SELECT vec_id AS session_id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings), cen AS (SELECT CAST(session_id AS INTEGER) AS cluster, f AS cf FROM v WHERE session_id < 4),
d AS (SELECT session_id, cluster, list_distance(f, cf) AS dist, label FROM v, cen)"""


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = vectors(spark, sf_dir).withColumn("g", F.lit(0))
    return p, p.where("session_id < 4").select("g", F.col("session_id").cast("int").alias("cluster"), F.col("features").alias("centroid"))


@query("c04_nearest_centroid", f"WITH {GIVEN} SELECT session_id, arg_min(cluster, (round(dist, 9), cluster)) AS cluster, round(min(dist), 6) AS distance FROM d GROUP BY session_id")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.nearest(*points(spark, sf_dir), ["g"]).select("session_id", "cluster", F.round("distance", 6).alias("distance"))


@query("n01_soft_assignment", f"""WITH {GIVEN}, s AS (SELECT session_id, cluster, exp(-dist / 0.5) / sum(exp(-dist / 0.5)) OVER (PARTITION BY session_id) AS p, row_number() OVER (PARTITION BY session_id ORDER BY dist, cluster) AS r FROM d)
SELECT session_id, max(CASE WHEN r = 1 THEN cluster END) AS cluster, round(max(CASE WHEN r = 1 THEN p END), 6) AS probability, max(CASE WHEN r = 2 THEN p END) > 0.2 AS co_viewing FROM s GROUP BY session_id""")
def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = c.with_margin(c.soft_assignment(*points(spark, sf_dir), ["g"]))
    return made.select("session_id", "cluster", F.round("probability", 6).alias("probability"), "co_viewing")


@query("c05_silhouettes", """WITH v AS (SELECT vec_id AS session_id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings), m AS (SELECT a.session_id, a.label AS l, b.label AS l2, avg(list_distance(a.f, b.f)) AS m, count(*) AS n FROM v a, v b GROUP BY ALL),
s AS (SELECT session_id, max(CASE WHEN l = l2 THEN CASE WHEN n > 1 THEN m ELSE 0.0 END END) AS a, min(CASE WHEN l <> l2 THEN m END) AS b FROM m GROUP BY session_id)
SELECT session_id, round(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM s""")
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.silhouettes(vectors(spark, sf_dir), "session_id", None, "true_person").withColumn("silhouette", F.round("silhouette", 6) + 0.0)


@query("hx02_cohesion", "WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings), g AS (SELECT label, i, var_pop(CAST(v AS DOUBLE)) AS s, count(*) AS n FROM x GROUP BY ALL) SELECT label AS cluster, max(n) AS n, round(sum(s * n), 6) AS wcss FROM g GROUP BY label")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.cohesion(vectors(spark, sf_dir).withColumnRenamed("true_person", "cluster")).withColumn("wcss", F.round("wcss", 6))


@query("c06_account_clusters")
def account_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = viewing_events(spark, sf_dir)
    scored = fx.normalised(fx.cluster_features(ops.sessions(events, 480), ops.session_genres(events, 480), KEYS), "account_id")
    return c.clustered_accounts(scored, fx.CLUSTER_FEATURES)


@query("c07_household_size")
def household_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.household_size(account_clusters(spark, sf_dir))


@query("g01_mixtures")
def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mixtures(vectors(spark, sf_dir), "true_person", "session_id")


@query("i03_online_replay")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.replayed(points(spark, sf_dir)[0], "g", "session_id", points(spark, sf_dir)[1])
