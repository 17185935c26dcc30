"""The weak-signal run: isolation, novelty, eligibility and its counters, against plain Python."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwire.operators import isolation, weak
from loomwire.params import DEFAULTS as P
from loomwire.plans import runs
from loomwire.storage import stored

NOW = datetime(2024, 3, 20, 12, tzinfo=timezone.utc)


def scores(spark, features):
    rows = spark.createDataFrame([(i, *map(float, f)) for i, f in enumerate(features)], "id long, a double, b double, c double, d double")
    s, enough = isolation.isolation(rows, "id", ["a", "b", "c", "d"])
    return [r["s"] for r in rows.select("id", s.alias("s")).orderBy("id").collect()], enough, isolation.sampled(rows, "id", ["a", "b", "c", "d"])


def test_isolation_is_within_the_unit_interval_and_lifts_outliers(spark):
    rng = np.random.default_rng(1)
    crowd = rng.normal(1.0, 0.1, (40, 4))
    got, enough, _ = scores(spark, np.vstack([crowd, [[99.0] * 4]]))
    assert enough
    assert all(0 <= s <= 1 for s in got)
    assert got[-1] > max(got[:-1])
    assert got[-1] > 0.5


def test_the_column_walks_the_trees_as_plain_python_does(spark):
    rng = np.random.default_rng(2)
    features = np.round(rng.normal(0, 3, (700, 4)), 1)
    features[:, 3] = 2.0  # a feature that tells nothing
    got, _, sample = scores(spark, features)
    forest = isolation.grow(sample)
    assert forest.rows == isolation.SAMPLE
    assert len(forest.roots) == isolation.TREES
    want = [2 ** (-np.mean(forest.paths(list(f))) / isolation.mean_path(forest.rows)) for f in features]
    assert got == pytest.approx(want)
    assert max(forest.value[i] for i, f in enumerate(forest.feature) if f < 0) <= forest.depth() + isolation.mean_path(forest.rows)


def test_equal_rows_and_few_rows(spark):
    got, enough, _ = scores(spark, np.ones((20, 4)))
    assert enough
    assert len(set(got)) == 1
    got, enough, _ = scores(spark, np.eye(4)[:3])
    assert not enough
    assert got == [0.0] * 3


def test_mean_path_is_the_known_one():
    assert [round(isolation.mean_path(n), 4) for n in (0, 1, 2, 256)] == [0.0, 0.0, 1.0, 10.2448]


EVENTS = "event_id long, cluster_id long, created_at timestamp, source_count int, credibility double, categories array<string>, incomplete boolean"


def at(days, hours=0):
    return NOW - timedelta(days=days, hours=hours)


def fixture(spark):
    rows = [
        (1, None, at(1), 3, 0.9, ["rare"], False),  # noise
        (2, None, at(20), 1, 0.9, ["news"], False),  # too old
        (3, None, at(1), 1, 0.9, ["news"], True),  # incomplete
        (4, None, at(1), 1, 0.9, ["news"], False),  # without a vector
        (5, None, at(2), 1, 0.5, [], False),  # without categories
        *[(10 + i, 7, at(0, i), 2, 0.6, ["news", "rare"] if i == 0 else ["news"], i == 4) for i in range(5)],  # a burst in a small cluster, one of it incomplete
        *[(20 + i, 8, at(20 + i), 1, 0.4, None if i else ["news"], False) for i in range(2)],  # small, with old members only
        *[(30 + i, 9, at(i % 3), 1, 0.9, ["news"], False) for i in range(6)],  # too large
        *[(40 + i, 11, at(1), 1, 0.9, ["news"], False) for i in range(3)],  # dormant
        (50, 12, at(3), 1, 0.8, ["news"], False),  # no vector at all
    ]
    events = spark.createDataFrame(rows, EVENTS)
    vectors = spark.createDataFrame([(r[0], [float(r[0] % 5 + 1), float(r[0] % 3), 1.0]) for r in rows if r[0] not in (4, 50)], "event_id long, v array<double>")
    clusters = events.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("event_count")).withColumn("status", F.when(F.col("cluster_id") == 11, "dormant").otherwise("active"))
    return rows, events, vectors, clusters


def test_candidates_are_noise_and_small_clusters(spark):
    _, events, vectors, clusters = fixture(spark)
    got = {(r["kind"], r["ref"]): r for r in weak.candidates(events, vectors, clusters, NOW).collect()}
    assert set(got) == {("event", 1), ("event", 5), ("cluster", 7), ("cluster", 8), ("cluster", 12)}
    seven = got["cluster", 7]
    assert (seven["distinct_sources"], seven["reports_per_day"], seven["categories"]) == (10, 10.0, ["news", "rare"])
    assert seven["mean_credibility"] == pytest.approx(0.6)
    assert (seven["daily"][-1], sum(seven["daily"]), len(seven["daily"])) == (5, 5, P.weak_days + 1)
    assert np.linalg.norm(seven["v"]) == pytest.approx(1)
    assert got["cluster", 8]["daily"] == [0] * (P.weak_days + 1)
    assert got["cluster", 12]["v"] is None
    assert (got["event", 1]["daily"][-2], sum(got["event", 1]["daily"])) == (1, 1)


def test_rarity_and_novelty(spark):
    rows, events, vectors, clusters = fixture(spark)
    cand = stored(weak.candidates(events, vectors, clusters, NOW))
    rare = {(r["kind"], r["ref"]): r["rarity"] for r in weak.rarest(cand, events, NOW).collect()}
    recent = [r for r in rows if not r[6] and r[2] >= NOW - timedelta(days=P.weak_days)]
    share = lambda c: sum(c in (r[5] or []) for r in recent) / len(recent)
    assert rare["event", 1] == pytest.approx(1 - share("rare"))
    assert rare["cluster", 7] == pytest.approx(1 - min(share("news"), share("rare")))
    assert rare["event", 5] == 1.0
    centres = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0])], "cluster_id long, centroid array<double>")
    v = {(r["kind"], r["ref"]): r["v"] for r in cand.collect()}
    new = {(r["kind"], r["ref"]): r["novelty"] for r in weak.novelties(cand, centres).collect()}
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    assert new["cluster", 7] == pytest.approx(1 - unit(v["cluster", 7])[1], abs=1e-8)  # not its own centroid
    assert new["event", 1] == pytest.approx(1 - max(unit(v["event", 1])[:2]), abs=1e-8)
    assert ("cluster", 12) not in new
    only = {(r["kind"], r["ref"]): r["novelty"] for r in weak.novelties(cand, centres.where("cluster_id = 7")).collect()}
    assert only["cluster", 7] == 1.0


def test_what_does_not_grow_is_not_detected_however_odd(spark):
    rows = spark.createDataFrame(
        [("event", 1, 1.0, 1, 1.0, 1.0, 0.0, 1.0), ("cluster", 2, 9.0, 9, 1.0, 0.5, 0.2, 0.9), ("cluster", 3, 9.0, 9, 0.1, 0.5, 0.2, 0.9), ("cluster", 4, 9.0, 9, 1.0, 0.5, 0.2, 0.9)],
        "kind string, ref long, reports_per_day double, distinct_sources long, mean_credibility double, rarity double, burst double, novelty double",
    )
    out, report = weak.detect(rows, spark.createDataFrame([(4,), (4,)], "ref long"))
    got = {r["ref"]: r for r in out.collect()}
    assert [(r["emerging"], r["detected"], r["already_open"]) for _, r in sorted(got.items())] == [(False, False, False), (True, True, False), (True, False, False), (True, True, True)]
    assert got[2]["combined"] == pytest.approx(0.4 * 0.9 + 0.3 * 0.2)  # too few candidates for isolation
    assert got[3]["combined"] == pytest.approx(got[2]["combined"] * 0.1)
    assert report.get == {"candidates": 4, "emerging": 3, "detected": 2, "already_open": 1, "isolation_skipped": 1}


def test_the_whole_run(spark, sf):
    """Each candidate's isolation from the trees in plain Python, and its score from its parts; counters equal plain counts."""
    rows = stored(runs._scored(spark, sf))
    out, report = weak.detect(rows, runs._open_refs(spark, sf))
    got = out.collect()
    forest = isolation.grow(isolation.sampled(rows.withColumn("_k", F.concat_ws(":", "kind", "ref")), "_k", weak.FEATURES))
    for r in got:
        alone = 2 ** (-np.mean(forest.paths([float(r[f]) for f in weak.FEATURES])) / isolation.mean_path(forest.rows))
        assert r["isolation"] == pytest.approx(alone)
        assert r["combined"] == pytest.approx((0.4 * r["novelty"] + 0.3 * alone + 0.3 * r["burst"]) * r["mean_credibility"])
        assert r["detected"] == (r["burst"] > 0 and r["combined"] >= P.weak_threshold)
    assert {r["kind"] for r in got} == {"event", "cluster"}
    counts = report.get
    assert counts == {"candidates": len(got), "emerging": sum(r["emerging"] for r in got), "detected": sum(r["detected"] for r in got), "already_open": sum(r["already_open"] for r in got), "isolation_skipped": 0}
    assert counts["detected"] > counts["already_open"] > 0
