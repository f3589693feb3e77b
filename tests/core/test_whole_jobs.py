"""Registered queries do the whole job: small tables against brute force."""

from __future__ import annotations

import datetime as dt
import itertools
import json

import duckdb
import numpy as np
import pytest

from kinsight.operators import clustering, linking, members, profiles
from kinsight.operators import uncertainty as u
from kinsight.plans import catalogue
from kinsight.sources.views import journey_steps
from kinsight.vocabulary import GENRES


def test_genre_overlap_of_all_accounts(spark, tmp_path):
    seen = {1: (5, 15), 12: (5,), 2: (15, 25), 25: (25, 95), 3: (95,), 900: (5, 15, 25)}
    rows = [(u, k) for u, ks in seen.items() for k in ks]
    made = [(i, u, dt.datetime(2024, 1, 1, i % 24), "view", 10.0, json.dumps({"k": k})) for i, (u, k) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    genres = {str(u): {GENRES[k // 10] for k in ks} for u, ks in seen.items()}
    want = {(a, b): len(genres[a] & genres[b]) for a, b in itertools.combinations(sorted(genres), 2) if genres[a] & genres[b]}
    got = {(r.a, r.b): r.shared for r in catalogue.queries()["u02_genre_overlap"](spark, str(tmp_path)).collect()}
    assert got == want and ("2", "25") in got


def test_mixtures_of_whole_vectors(spark, tmp_path):
    """The first four components are alike; two groups differ in the other sixty."""
    r = np.random.default_rng(3)
    x = r.normal(0, 0.05, (60, 64)).astype("float32")
    x[30:, 4:] += 5
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = sorted(catalogue.queries()["g01_mixtures"](spark, str(tmp_path)).collect(), key=lambda r: r.session_id)
    found = [r.component for r in rows]
    assert len(set(found)) == 2 and len(set(found[:30])) == 1 == len(set(found[30:]))


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q03_bootstrap_intervals", "q04_dirichlet_intervals"])
def test_intervals_of_100_samples(spark, name):
    assert {r.n for r in catalogue.queries()[name](spark, SF).collect()} == {100}


def test_wider_source_of_100_samples(spark):
    steps = journey_steps(spark, SF)
    want = {tuple(r) for r in u.wider_source(u.bootstrap(steps, 100), u.dirichlet(steps, 100)).collect()}
    assert {tuple(r) for r in catalogue.queries()["q05_wider_source"](spark, SF).collect()} == want


def test_genre_overlap_shuffles_no_pairs(spark):
    plan = catalogue.queries()["u02_genre_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan


def test_device_links_are_the_same_in_blocks_of_any_size(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, catalogue.queries()["l01_device_links"](spark, SF).collect()))
    want = rows()
    monkeypatch.setattr(linking, "BLOCK_DEVICES", 17)
    monkeypatch.setattr(linking, "SLICE_DEVICES", 4)
    assert want and rows() == want


def test_silhouettes_in_blocks_of_any_size(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, (30, 8)), r.normal(3, 1, (29, 8))])
    x[5] = x[6] + 1e-9
    label = np.array([0] * 30 + [1] * 28 + [2])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(clustering.distances(x, x), d, rtol=1e-9, atol=1e-13)
    means = np.stack([d[:, label == k].mean(axis=1) for k in range(3)], axis=1)
    a = np.where(label == 2, 0.0, means[np.arange(59), label])
    b = np.where(label[:, None] == np.arange(3), np.inf, means).min(axis=1)
    monkeypatch.setattr(clustering, "BLOCK_POINTS", 7)
    monkeypatch.setattr(clustering, "SLICE_POINTS", 3)
    frame = spark.createDataFrame([(str(i), f"c{k}", v.tolist()) for i, (v, k) in enumerate(zip(x, label))], "id string, cluster string, features array<double>")
    got = {int(s.id): s.silhouette for s in clustering.silhouettes(frame, "id").collect()}
    assert np.allclose([got[i] for i in range(59)], (b - a) / np.maximum(a, b))


def test_temporal_pairs_are_whole_in_blocks_of_any_size(spark, monkeypatch):
    r = np.random.default_rng(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    made = [(f"{u}-{u % 3}", start + dt.timedelta(microseconds=int(t))) for u, t in zip(r.integers(0, 40, 400), r.integers(0, 6 * 3600_000_000, 400))]
    made += [("0-x", start), ("é", start), ("0-x", start + dt.timedelta(minutes=30)), ("1", None), (None, start)]
    want = {}
    for (a, t), (b, u) in itertools.product((x for x in made if None not in x), repeat=2):
        if a < b and abs(t - u) <= dt.timedelta(minutes=30):
            near, n = want.get((a, b), (0, 0))
            want[a, b] = near + 1 - abs(t - u) / dt.timedelta(minutes=30), n + 1
    frame = spark.createDataFrame(made, "device_id string, start_time timestamp")
    for sizes in ({}, {"PAIR_DEVICES": 7, "PAIR_CELLS": 20, "PAIR_STARTS": 5}, {"PAIR_SESSIONS": 60, "PAIR_CELLS": 1}):
        for name, value in sizes.items():
            monkeypatch.setattr(linking, name, value)
        found = linking.temporal_pairs(frame)
        rows = found.collect()
        got = {(x.a, x.b): x for x in rows}
        assert len(rows) == len(got) and {k: x.pairs for k, x in got.items()} == {k: n for k, (_, n) in want.items()}
        assert all(abs(x.closeness - want[k][0]) < 1e-9 for k, x in got.items())
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert linking.temporal_pairs(frame.limit(0)).collect() == []


def test_closeness_is_rounded_as_in_the_sql(spark, tmp_path):
    """Halves of a millionth, as the stored doubles have them."""
    gaps = [900 + 1800 * n for n in [*range(100), 1984, 2872, 4038, 4343, 4926, 5231, 5814, 6397, 992_021, 992_160, 994_824]]
    start = dt.datetime(2024, 1, 1)
    made = [(2 * i + e, 2 * i + e, start + dt.timedelta(hours=2 * i, microseconds=g * e), "view", 1.0, '{"k": 1}') for i, g in enumerate(gaps) for e in (0, 1)]
    spark.createDataFrame(made, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert spark_rows(spark, "j07_temporal_pairs", tmp_path, "a, b, pairs, closeness") == sql_rows("j07_temporal_pairs", tmp_path, "a, b, pairs, closeness")


def spark_rows(spark, name, folder, columns):
    return sorted(map(tuple, catalogue.queries()[name](spark, str(folder)).select(*columns.split(", ")).collect()))


def sql_rows(name, folder, columns):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return sorted(con.sql(f"SELECT {columns} FROM ({catalogue.oracles()[name]})").fetchall())


def odd_events(spark, folder):
    """Whole amounts; missing values, accounts and genres."""
    r = np.random.default_rng(11)
    made = []
    for i in range(900):
        u, v, k = (int(x) for x in r.integers(0, (60, 4, 100)))
        props = None if i % 6 == 0 else "{}" if i % 13 == 0 else json.dumps({"k": k})
        made.append((i, None if i % 50 == 0 else u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "view", None if i % 5 < 2 else float(v), props))
    spark.createDataFrame(made, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def test_top_genres_of_missing_values(spark, tmp_path):
    odd_events(spark, tmp_path)
    got = catalogue.queries()["r04_top_genres"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert set(map(tuple, got)) == set(con.sql(catalogue.oracles()["r04_top_genres"]).fetchall())


def test_order_of_addition_decides_no_rank(spark):
    frame = spark.createDataFrame([("a", "x", 0.1 + 0.2 + 0.3), ("a", "w", 0.3 + 0.2 + 0.1), ("a", "v", 0.5)], "id string, genre string, amount double")
    assert [r.genre for r in profiles.top_k(frame, ["id"], "genre", "amount", 3).orderBy("rank").collect()] == ["w", "x", "v"]


def test_descriptions_of_missing_values(spark, tmp_path):
    odd_events(spark, tmp_path)
    columns = "account_id, description"
    assert spark_rows(spark, "p20_descriptions", tmp_path, columns) == sql_rows("p20_descriptions", tmp_path, columns)


def test_order_of_addition_decides_no_bracket(spark):
    made = [("a", "Kids", 0.1 + 0.2 + 0.3), ("a", "Action", 0.3 + 0.2 + 0.1), ("b", "Action", 0.1 + 0.2 + 0.3), ("b", "Drama", 0.3 + 0.2 + 0.1)]
    found = members.age_brackets(spark.createDataFrame(made, "id string, genre string, amount double"), "id")
    assert {r.id: r.bracket for r in found.collect()} == {"a": "teen", "b": "adult"}


def linked_devices(r, n=90):
    """Sessions and genres of devices: some alike, some met at all times, with bursts, several accounts, no durations and no times."""
    start, made, genres = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), [], []
    for d in range(n):
        like = d % 30 if d >= 60 else d
        s = np.random.default_rng(like)
        hours = s.choice([2, 9, 20], 5 + like % 9) if like % 3 else s.integers(0, 24, 5 + like % 9)
        at = [int(24 * 60 * x + 60 * h + s.integers(0, 60)) for x, h in zip(s.permutation(25), hours)]
        if 20 <= like < 30:  # meets device 7 at nearly all times, with other tastes and durations
            t = np.random.default_rng(7)
            h7 = t.choice([2, 9, 20], 5 + 7 % 9)
            at = [int(24 * 60 * x + 60 * h + t.integers(0, 60)) + int(r.integers(0, 3)) for x, h in zip(t.permutation(25), h7)]
        if like % 11 == 3:
            at += [at[0] + 5, at[0] + 9]
        for k, minute in enumerate(at):
            account = f"a{d // 4}" if d % 7 or k % 2 else f"a{(d + 5) // 4}"
            duration = None if like % 13 == 5 else 0.0 if like % 17 == 4 else float(1 + like % 20)
            made.append((f"{d}-é" if d % 5 == 0 else str(d), account, None if k == 1 and like == 9 else start + dt.timedelta(minutes=minute), (minute // 60) % 24, duration))
        genres += [(made[-1][0], g, float(x)) for g, x in zip(("x", "y", "z", None), s.integers(0, 30, 4)) if like % 12]
    return made, genres


def brute_links(made, genres, threshold):
    by = {}
    for d, account, t, hour, duration in made:
        by.setdefault(d, []).append((account, t, hour, duration))
    out = {}
    cosine = lambda p, q: 0.0 if not any(p.values()) or not any(q.values()) else sum(p[k] * q.get(k, 0) for k in p) / np.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
    taste = {d: {g: x for e, g, x in genres if e == d and g is not None} for d in by}
    hours = {d: {h: sum(y[2] == h for y in rows) for h in {y[2] for y in rows}} for d, rows in by.items()}
    known = {d: [y[3] for y in rows if y[3] is not None] for d, rows in by.items()}
    mean = {d: np.mean(v) if v else np.nan for d, v in known.items()}
    for a, b in itertools.combinations(sorted(by), 2):
        one, two = by[a], by[b]
        near = sum(1 - abs(x[1] - y[1]) / dt.timedelta(minutes=30) for x in one for y in two if x[1] and y[1] and abs(x[1] - y[1]) <= dt.timedelta(minutes=30))
        t = min(1.0, near / min(len(one), len(two)))
        longest = np.fmax(mean[a], mean[b])
        m = (cosine(hours[a], hours[b]) + cosine(taste[a], taste[b]) + (np.fmin(mean[a], mean[b]) / longest if longest > 0 else 0)) / (3 if longest > 0 else 2)
        p, q = {x[0] for x in one}, {x[0] for x in two}
        login = len(p & q) / max(len(p), len(q))
        parts = [(v, w) for v, w in ((t, 2.0), (m, 1.5), (login, 5.0)) if v > 0]
        score = sum(v * w for v, w in parts) / sum(w for _, w in parts) if parts else 0.0
        chance = 1 / (1 + np.exp(-(2 * score - 1))) if parts else 0.0
        if chance >= threshold:
            out[a, b] = (login, t, m, score, chance)
    return out


def test_device_links_are_those_of_all_pairs(spark, monkeypatch):
    made, genres = linked_devices(np.random.default_rng(5))
    sessions = spark.createDataFrame([(f"s{i}", *x) for i, x in enumerate(made)], "session_id string, device_id string, account_id string, start_time timestamp, hour_of_day int, total_duration double")
    seconds = spark.createDataFrame(genres, "device_id string, genre string, seconds double")
    for threshold, sizes in ((0.66, {}), (0.7, {"BLOCK_DEVICES": 9, "SLICE_DEVICES": 4, "SLICE_OTHERS": 3, "SCORED_PAIRS": 5, "PAIR_STARTS": 40}), (0.62, {}), (0.2, {})):
        for name, value in sizes.items():
            monkeypatch.setattr(linking, name, value)
        want = brute_links(made, genres, threshold)
        rows = linking.device_links(sessions, seconds, threshold).collect()
        got = {(x.a, x.b): tuple(x)[2:] for x in rows}
        assert len(rows) == len(got) and set(got) == set(want)
        assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)
    met = [v for v in brute_links(made, genres, 0.66).values() if v[0] == 0]
    assert sum(v[1] > 0.9 > 0.8 > v[2] for v in met) > 5 and sum(v[1] == 0 for v in met) > 5


def test_few_pairs_of_devices_are_scored():
    """Of 400 devices at random times those that meet or are alike, not all 79,800 pairs."""
    r = np.random.default_rng(1)
    times = [sorted(r.integers(0, 30 * 86_400_000_000, 12).tolist()) for _ in range(399)]
    times.append([t + 1_000_000 for t in times[0]])
    some = lambda k, n: [[str(v) for v in r.permutation(k)[:n]] for _ in range(400)]
    amounts = lambda n: r.integers(1, 9, (400, n)).astype(float).tolist()
    table = linking.pa.table({"n": [12] * 400, "avg_duration": r.exponential(50, 400) + 1, "hours": some(24, 9), "hours_x": amounts(9), "genres": some(10, 5), "genres_x": amounts(5), "times": times})
    p, every = linking.Profiles(table, 1_800_000_000), np.arange(400)
    a, b = (z.ravel() for z in np.meshgrid(every, every))
    for found, signal in ((p.met(every, every, 0.83, False), np.minimum(1, p.closeness(a, b) / 12)), (p.alike(every, every, 0.83), p.behavioral(a, b))):
        pairs = {(int(i), int(j)) for x, y in found for i, j in zip(x, y)}
        assert {(int(i), int(j)) for i, j in zip(a[signal >= 0.83], b[signal >= 0.83])} <= pairs
        assert 400 < len(pairs) < 0.05 * 400 * 400
