"""Operators on literal fixtures and invariants."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kinsight.functions import validation as v
from kinsight.operators import attribution as a
from kinsight.operators import clustering as c
from kinsight.operators import evaluation as e
from kinsight.operators import linking as k
from kinsight.operators import privacy as p
from kinsight.operators import sessions as s
from kinsight.operators import drift, profiles
from kinsight.sources import files
from kinsight.vocabulary import KIDS_GENRES


def steps(spark, *journeys):
    rows = [(j, i + 1, ch, won, value) for j, (path, won, value) in enumerate(journeys) for i, ch in enumerate(path)]
    return spark.createDataFrame(rows, "person long, position int, channel string, converted boolean, value double")


def events(spark, *rows):
    made = [(i, a_, d, dt.datetime.fromisoformat(t), "click", "tv", "Drama", "Email", 10.0, 0.0) for i, (a_, d, t) in enumerate(rows)]
    return spark.createDataFrame(made, "event_id long, account_id string, device_id string, ts timestamp, event_type string, device_type string, genre string, channel string, duration_sec double, conversion_value double")


def test_inclusive_gap(spark):
    frame = events(spark, ("a", "d", "2024-01-01T00:00:00"), ("a", "d", "2024-01-01T00:30:00"), ("a", "d", "2024-01-01T01:00:01"))
    counts = sorted(r.event_count for r in s.sessions(frame, 30).collect())
    assert counts == [1, 2] == sorted(r.event_count for r in s.window_sessions(frame, 30).collect())


def test_attribution_fixture(spark):
    j = steps(spark, (["Email", "Search"], True, 0.0), (["Search", "Social"], True, 0.0), (["Email", "Social", "Search"], False, 0.0))
    values, channels = a.coalition_values(a.transition_counts(j))
    removal = {r.channel: r.effect for r in a.removal_effects(values, channels).collect()}
    shapley = {r.channel: r.shapley for r in a.shapley_values(values, channels).collect()}
    assert removal == pytest.approx({"Email": 0.466667, "Search": 0.5, "Social": 0.444444}, abs=1e-6)
    assert shapley == pytest.approx({"Email": 0.201852, "Search": 0.274074, "Social": 0.190741}, abs=1e-6)
    assert sum(shapley.values()) == pytest.approx(2 / 3)
    assert a.axioms(a.shapley_values(values, channels), values, channels).first().efficiency
    assert dict(a.state_visits(j).values)["Email"] > 0


def test_hybrid_value(spark):
    j = steps(spark, (["Email", "Search"], True, 100.0), (["Search", "Social"], True, 200.0))
    made = {r.channel: r for r in a.hybrid(j).collect()}
    assert sum(r.value for r in made.values()) == pytest.approx(300)
    assert sum(r.share for r in made.values()) == pytest.approx(1)
    assert made["Search"].shapley_share == pytest.approx(0.583333, abs=1e-6)


def test_single_channel(spark):
    values, channels = a.coalition_values(a.transition_counts(steps(spark, (["A"], True, 1.0), (["A"], False, 0.0))))
    assert a.removal_effects(values, channels).first().effect == pytest.approx(0.5)
    assert a.shapley_values(values, channels).first().shapley == pytest.approx(0.5)


def test_too_many_channels(spark):
    with pytest.raises(ValueError):
        a.coalition_values(a.transition_counts(steps(spark, ([f"c{i:02d}" for i in range(13)], True, 1.0))))


def test_link_ceiling(spark):
    row = spark.range(1).select(*k.combined({"login": (F.lit(1.0), 5.0)}), *k.combined({"login": (F.lit(0.0), 5.0)})).first()
    assert row[1] == pytest.approx(0.731059, abs=1e-6) and row[3] == 0.0


def test_components(spark):
    k.prepare_checkpoints(spark)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "x"), ("f", "f")], "a string, b string")
    assert dict((r.node, r.component) for r in k.components(edges).collect()) == {"a": "a", "b": "a", "c": "a", "x": "a", "d": "d", "e": "d"}
    assert k.components(edges.limit(0)).collect() == []


def test_silhouette_forms_agree(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 0.5, (30, 2)), r.normal(10, 0.5, (30, 2))])
    labels, centroids, score = c.best_clusters(x, r)
    assert len(centroids) == 2 and score > 0.8
    frame = spark.createDataFrame([(i, p_.tolist(), int(q)) for i, (p_, q) in enumerate(zip(x, labels))], "id long, features array<double>, cluster int")
    assert c.silhouettes(frame, "id").agg(F.avg("silhouette")).first()[0] == pytest.approx(score)


def test_calibration_bounds(spark):
    perfect = spark.createDataFrame([(1.0, 1.0)] * 5 + [(0.0, 0.0)] * 5, "p double, y double")
    made = e.calibration(perfect).first()
    assert made.brier == 0 and made.ece == 0 and made.grade == "excellent"


def test_empty_link_sets_agree(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert e.link_scores(none, none).first().f1 == 1.0


def test_validation_raises(spark):
    frame = events(spark, ("<a", "d", "2024-01-01T00:00:00"))
    with pytest.raises(Exception, match="account_id_characters"):
        v.raise_on_errors(v.validate_events(frame)).collect()
    assert not v.validate_batch(frame.limit(0)).first().is_valid


def test_audit_chain_detects_change(spark):
    rows = [("c", i, "view", "me", "view", 'r"x', "2024") for i in range(5)]
    log = p.chained(spark.createDataFrame(rows, "chain string, seq long, action string, actor string, event_type string, resource string, ts string"))
    assert p.broken_links(log).count() == 0
    assert p.broken_links(log.withColumn("actor", F.when(F.col("seq") == 2, "you").otherwise(F.col("actor")))).count() == 1


def test_nested_households_round_trip(spark):
    homes = spark.createDataFrame([("a", 2), ("b", 0)], "account_id string, size int")
    people = spark.createDataFrame([("a", "p2", 0.4), ("a", "p1", 0.6)], "account_id string, person_id string, share double")
    whole = files.nested(homes, people, "account_id")
    back = files.decoded_as(files.encoded(whole), "json", whole.schema)
    rows = {r.account_id: [(m.person_id, m.share) for m in r.members] for r in back.collect()}
    assert rows == {"a": [("p1", 0.6), ("p2", 0.4)], "b": []}


def test_graph_and_snapshots_on_disk(spark, tmp_path):
    nodes = spark.createDataFrame([("d1", "device"), ("d2", "device"), ("p", "person")], "id string, type string")
    edges = spark.createDataFrame([("d1", "p", "used_by"), ("d2", "p", "used_by")], "src string, dst string, type string")
    files.write_graph(nodes, edges, str(tmp_path / "graph"))
    read_nodes, read_edges = files.read_graph(spark, str(tmp_path / "graph"))
    assert sorted(map(tuple, read_nodes.collect())) == sorted(map(tuple, nodes.collect())) and read_edges.count() == 2
    told = json.loads(files.graph_document(read_nodes, read_edges).first().metadata)
    assert told == {"node_count": 3, "edge_count": 2, "node_types": {"device": 2, "person": 1}, "edge_types": {"used_by": 2}}
    for version in range(7):
        files.append_snapshot(spark.createDataFrame([("k", [0.5, float(version)])], "cluster string, centroid array<double>"), str(tmp_path / "models"), version)
    kept = files.read_snapshots(spark, str(tmp_path / "models"))
    assert sorted((r.version, r.centroid[1]) for r in kept.collect()) == [(k, float(k)) for k in range(2, 7)]


def test_attribution_events_as_lines(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "Email", 2.5), ("e2", "Search", 0.0)], "event_id string, channel string, value double")
    files.write_json_events(rows, str(tmp_path / "events"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "events")).collect()]
    assert sorted(x["event_id"] for x in lines) == ["e1", "e2"] and {x["channel"] for x in lines} == {"Email", "Search"}


def persona_rows(spark, hours):
    """A device's sessions at the given hours, all its time in one kids' genre."""
    made = spark.createDataFrame([("d", "a", "tv", h) for h in hours], "device_id string, account_id string, device_type string, hour_of_day int")
    return made, spark.createDataFrame([("d", KIDS_GENRES[0], 5.0)], "device_id string, genre string, seconds double")


def test_personas_just_at_a_limit(spark):
    """3 of 10 sessions in three hours of the afternoon are not more than 0.3, as sums of rounded shares would have it."""
    at, over = ([14, 15, 16] + [9] * k for k in (7, 6))
    assert [profiles.personas(*persona_rows(spark, h), "device_id").first().persona for h in (at, over)] == ["secondary_adult", "child"]


def test_rooms_just_at_a_limit(spark):
    """Three late sessions in three hours and six in the evening: late is half the evening, not more."""
    made = spark.createDataFrame([("d", "tv", h, i) for i, h in enumerate([23, 0, 1, *[20] * 6, 12])], "device_id string, device_type string, hour_of_day int, start_time int").withColumn("session_id", F.col("start_time").cast("string"))
    assert profiles.device_rooms(made).first().room == "living_room"


def test_rollback_just_at_a_limit(spark):
    """0.4 - 0.3 exceeds 0.1 by rounding alone."""
    rows = [(0.2, 0.2, 0.3, 0.4), (0.2, 0.2, 0.299, 0.4)]
    made = spark.createDataFrame(rows, "brier double, base_brier double, accuracy double, base_accuracy double")
    assert [r.roll_back for r in drift.should_roll_back(made).orderBy(F.desc("accuracy")).collect()] == [False, True]
