"""Operator 9 where common signatures are left out, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kinsight.llm import jaccard_join as jj
from tests.llm.helpers import docs, rows_of
from tests.llm.test_text_operators import linked


def signed(sets, similar):
    """Signatures by set and role, and what empty subsets leave of S."""
    h = np.concatenate(sets)
    n = np.array([len(x) for x in sets])
    s, of, role, spare = jj.signatures(h, np.repeat(np.arange(len(n)), n), n, similar)
    found = {}
    for a, b, c in zip(s.tolist(), of.tolist(), role.tolist()):
        found.setdefault((b, c), set()).add(a)
    return found, spare


@pytest.mark.parametrize("similar", [(3, 4), (1, 2), (7, 10), (9, 10)])
def test_similar_pairs_of_all_sizes_share_more_than_is_asked(similar):
    """Pairs just at the threshold share 1 + S signatures, less the weak groups of either side."""
    num, den = similar
    r = np.random.default_rng(5)
    hashes = lambda k: np.sort(r.integers(0, 1 << 63, k, dtype=np.uint64))
    pairs = []
    for n in [*range(2, 40), 64, 65, 90, 127, 200, 333, 800]:
        for m in range(-(-n * num // den), n + 1):
            both = -(-(m + n) * num // (num + den))
            if both <= m and (n < 40 or r.random() < 0.1):
                core = hashes(both)
                pairs.append((np.sort(np.concatenate([core, hashes(m - both)])), np.sort(np.concatenate([core, hashes(n - both)]))))
    found, spare = signed([x for p in pairs for x in p], similar)
    for k, (a, b) in enumerate(pairs):
        if len(np.setxor1d(a, b)) == 0:
            continue
        shared, needs = [], []
        for x, y in ((0, 0), (1, 2)):
            if spare[2 * k, x] < 1 << 20 and spare[2 * k + 1, y] < 1 << 20:
                shared.append(len(found.get((2 * k, x), set()) & found.get((2 * k + 1, y), set())))
                needs.append(max(spare[2 * k, x], spare[2 * k + 1, y]))
        # an instance that holds the pair finds it, or both sets belong to the remainder
        assert any(s > need or need < 0 for s, need in zip(shared, needs)), (len(a), len(b))


@pytest.mark.parametrize("common", [2, 64])
def test_template_texts_of_all_sizes(spark, monkeypatch, common):
    """Groups that share all but a few words, with pairs at the threshold among them, in groups beyond COMMON and blocks."""
    monkeypatch.setattr(jj, "COMMON", common)
    monkeypatch.setattr(jj, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jj, "BROADCAST_ROWS", 10)
    r = random.Random(12)
    rows = []
    for size in (6, 9, 14, 22, 40, 75):
        opening = [f"t{size}w{k}" for k in range(size)]
        for k in range(24):
            tail = [f"x{r.randrange(10**6)}" for _ in range(size // 3)]
            rows += [(len(rows), " ".join(opening + tail)), (len(rows) + 1, " ".join(opening + tail[:-1] + [f"y{k}"])), (len(rows) + 2, " ".join(opening + tail + tail[: size // 5]))]
    got = rows_of(jj.similar_components(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == linked(rows)


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(1)
    for n, m in ((3, 3), (40, 55), (900, 1100), (5000, 400), (3000, 3100)):
        core = r.integers(0, 1 << 63, min(n, m) // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([core, r.integers(0, 1 << 63, k - len(core), dtype=np.uint64)])) for k in (n, m))
        assert jj.sketch_distance(jj.sketch_of(a), jj.sketch_of(b)) <= len(np.setxor1d(a, b))


def test_short_texts_with_a_common_opening(spark):
    """Texts of 7 and 8 words: their first two shingles are common signatures, the others are rare."""
    r = random.Random(8)
    opening = "the same six words open all".split()
    rows = []
    for k in range(100):
        tail = [f"w{k}a{r.randrange(10**6)}", f"w{k}b{r.randrange(10**6)}"]
        rows += [(2 * k + 1, " ".join(opening + tail[:1])), (2 * k + 2, " ".join(opening + tail))]
    got = rows_of(jj.similar_components(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == linked(rows)
    assert len({c for *_, c in got}) == 100


def test_elements_are_told_apart_by_64_bits():
    h, owner = jj.shingles([f"short text {i}".encode() for i in range(1000)], 5)
    assert len(h) == 1000 and (owner == np.arange(1000)).all()
    assert all(300 < (h >> np.uint64(b) & np.uint64(1)).sum() < 700 for b in range(64))


@pytest.mark.parametrize("limits", [{}, {"PASS_ELEMENTS": 500, "PASS_COLUMNS": 3}, {"DENSE": 10**9}])
def test_shared_counts_of_frequent_and_rare_elements(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jj, name, value)
    r = np.random.default_rng(4)
    sets = [np.unique(r.zipf(1.3, r.integers(1, 60)).astype(np.uint64)) for _ in range(120)] + [np.zeros(0, np.uint64)]
    a, b = sets[:50], sets[40:]
    assert (jj.shared_counts(a, b) == np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])).all()


def test_sets_of_one_template_are_compared_once(spark):
    """Two templates of 30 sets by 20 common elements, and a chain whose joint group would cost more than its parts."""
    rows = [(100 * t + e, 1000 * t + k, k, 50) for t in (1, 2) for e in range(20) for k in range(30)]
    rows += [(900 + e, 9000 + 5 * e + k, k, 50) for e in range(12) for k in range(6)]
    members = spark.createDataFrame(rows, "element long, node long, label long, n long")
    with jj.Scratch(spark) as keep:
        got = {(r.element, r.node) for r in jj.gathered(members, keep).collect()}
    assert got == {(1000 * t, 1000 * t + k) for t in (1, 2) for k in range(30)} | {(e, x) for e, x, *_ in rows if e >= 900}
