"""Matching to the end against a serial greedy pass, and the snapshot after a run."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from loomwire.operators import snapshot


def serial(new, old, floor):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    pairs = sorted((-round(float(unit(a) @ unit(b)), 9), i, j) for i, a in new for j, b in old)
    taken, out = (set(), set()), []
    for s, i, j in pairs:
        if -s >= floor and i not in taken[0] and j not in taken[1]:
            taken[0].add(i), taken[1].add(j)
            out.append((i, j))
    return sorted(out)


def run(spark, new, old, floor, k):
    side = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    return sorted((r["new_id"], r["old_id"]) for r in snapshot.match(side(new), side(old), floor, k).collect())


@pytest.mark.parametrize(("seed", "spread", "k"), [(1, 0.05, 1), (2, 0.3, 2), (3, 0.1, 5)])
def test_equals_a_serial_pass_with_many_rivals(spark, seed, spread, k):
    """All rows lie around few directions, so most partners of a list are taken by others and lists must be asked again."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 6))
    new = [(i, (centres[i % 3] + rng.normal(0, spread, 6)).tolist()) for i in range(40)]
    old = [(i, (centres[i % 3] + rng.normal(0, spread, 6)).tolist()) for i in range(35)]
    want = serial(new, old, 0.9)
    assert len(want) > 25
    assert run(spark, new, old, 0.9, k) == want


def test_equal_rows_go_by_their_ids(spark):
    new, old = [(i, [1.0, 2.0]) for i in range(12)], [(i, [2.0, 4.0]) for i in (3, 5, 7, 100, 101, 102, 103)]
    assert run(spark, new, old, 0.9, 2) == [(i, j) for i, (j, _) in enumerate(old)]


def test_nothing_above_the_floor_and_empty_sides(spark):
    assert run(spark, [(1, [1.0, 0.0])], [(1, [0.0, 1.0])], 0.9, 3) == []
    assert run(spark, [], [(1, [0.0, 1.0])], 0.9, 3) == []
    assert run(spark, [(1, [0.0, 1.0])], [], 0.9, 3) == []


NOW = datetime(2024, 3, 20, 12, tzinfo=timezone.utc)
CLUSTERS = "cluster_id long, label string, first_seen timestamp, last_seen timestamp, event_count long, status string"
EVENTS = "event_id long, cluster_id long, created_at timestamp, occurred_at timestamp"


def test_a_run_takes_over_ids(spark):
    at = lambda d: NOW - timedelta(days=d)
    clusters = spark.createDataFrame(
        [(1, "kept", at(30), at(5), 9, "dormant"), (2, "dissolved", at(30), at(1), 2, "active"), (3, "not seen, fresh", at(9), at(2), 1, "active"), (4, "not seen, stale", at(30), at(8), 1, "active"), (5, "long gone", at(90), at(80), 4, "dormant")],
        CLUSTERS,
    )
    events = spark.createDataFrame(
        [(10, 1, at(3), at(2)), (11, 2, at(4), at(6)), (12, 2, at(5), at(5)), (13, 3, at(2), at(2)), (14, 4, at(8), at(8)), (15, None, at(1), at(1)), (16, 1, at(1), at(1))],
        EVENTS,
    )
    members = spark.createDataFrame([(10, 0, "b"), (11, 0, "c"), (12, None, "n"), (15, 1, "first"), (16, 1, "other")], "event_id long, label long, title string")
    matches = spark.createDataFrame([(0, 1)], "new_id long, old_id long")
    c, e = snapshot.persisted(clusters, events, members, matches, NOW)
    got = {r["cluster_id"]: r for r in c.collect()}
    new = next(i for i in got if i > 5)
    assert set(got) == {1, 2, 3, 4, 5, new}
    assert (got[1]["label"], got[1]["event_count"], got[1]["status"]) == ("b", 2, "active")
    assert got[1]["first_seen"].timestamp() == at(30).timestamp()
    assert got[1]["last_seen"].timestamp() == at(2).timestamp()
    assert (got[2]["event_count"], got[2]["status"]) == (0, "dormant")
    assert (got[3]["event_count"], got[3]["status"]) == (1, "active")
    assert (got[4]["event_count"], got[4]["status"]) == (1, "dormant")
    assert (got[5]["event_count"], got[5]["status"]) == (4, "dormant")
    assert (got[new]["label"], got[new]["event_count"]) == ("first", 2)
    assert {r["event_id"]: r["cluster_id"] for r in e.collect()} == {10: 1, 11: 1, 12: None, 13: 3, 14: 4, 15: new, 16: new}
    again, _ = snapshot.persisted(clusters, events, members, matches, NOW)
    assert {r["cluster_id"] for r in again.collect()} == set(got)


def test_ids_live_through_two_runs(spark):
    """Match, persist, match again: groups keep their ids while members come and go."""
    rng = random.Random(5)
    groups = {g: [rng.gauss(0, 1) for _ in range(8)] for g in range(6)}
    vector = lambda g: [x + rng.gauss(0, 0.05) for x in groups[g]]
    from loomwire.operators.vectors import centroids

    clusters, ids = spark.createDataFrame([], CLUSTERS), None
    events = spark.createDataFrame([(i, None, NOW, NOW) for i in range(60)], EVENTS)
    vectors = spark.createDataFrame([(i, vector(i % 6)) for i in range(60)], "event_id long, v array<double>")
    old = spark.createDataFrame([], "id long, v array<double>")
    for turn in range(2):
        # the second run numbers its groups the other way round, and has lost some members
        members = spark.createDataFrame([(i, (i % 6) if turn == 0 else 5 - i % 6, f"t{i}") for i in range(60) if turn == 0 or i % 5], "event_id long, label long, title string")
        new = centroids(members.select("event_id", "label").join(vectors, "event_id"), "label").selectExpr("label AS id", "centroid AS v")
        clusters, events = snapshot.persisted(clusters, events, members, snapshot.match(new, old, 0.9), NOW)
        held = {r["event_id"]: r["cluster_id"] for r in events.collect()}
        now = {g: {held[i] for i in range(60) if i % 6 == g and (turn == 0 or i % 5)} for g in range(6)}
        assert all(len(x) == 1 for x in now.values())
        assert ids is None or now == ids
        ids = now
        old = centroids(events.select("event_id", "cluster_id").join(vectors, "event_id")).selectExpr("cluster_id AS id", "centroid AS v")
