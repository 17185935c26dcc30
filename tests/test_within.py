"""The interval and pivot join against brute force, and what it skips."""

from __future__ import annotations

import numpy as np
import pytest

from loomwire.operators import within
from loomwire.plans import runs


def brute(rows, floor, seconds):
    out = set()
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v, _ in rows}
    for i, _, s in rows:
        for j, _, t in rows:
            if i < j and (seconds is None or abs(s - t) <= seconds) and round(float(unit[i] @ unit[j]), 9) >= floor:
                out.add((i, j))
    return out


@pytest.mark.parametrize(("floor", "seconds", "pivots", "block"), [(0.88, 700, 16, 2048), (0.88, None, 8, 10), (0.5, 100, 3, 7), (0.99, 5000, 1, 50)])
def test_equals_brute_force_and_skips_blocks(spark, floor, seconds, pivots, block):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.15, 8)).tolist(), int(rng.integers(0, 5000))) for i in range(300)]
    rows += [(300 + i, rows[0][1], rows[0][2] + i) for i in range(30)] + [(400, [0.0] * 8, 10), (401, [0.0] * 8, 11)]
    df = spark.createDataFrame(rows, "id long, v array<double>, at long")
    got = within.alike(df, floor, seconds, pivots=pivots, block=block).collect()
    want = brute(rows, floor, seconds)
    assert {(r["a"], r["b"]) for r in got} == want
    assert len(got) == len(want) > 100


def test_far_blocks_are_never_sent(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(16)[i % 16] + rng.normal(0, 0.01, 16)).tolist(), i) for i in range(320)]
    _, found = within.blocks(spark.createDataFrame(rows, "id long, v array<double>, at long"), 0.9, None)
    kept = {r["kept"]: r["count"] for r in within.pairs_of_blocks(found, 0.9).groupBy("kept").count().collect()}
    assert kept[False] > 2 * kept[True]


def test_empty(spark):
    assert within.alike(spark.createDataFrame([], "id long, v array<double>, at long"), 0.9, 10).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_most_alike_of_the_time_before_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=8).round(3).tolist(), int(rng.integers(0, 3000))) for i in range(200)]
    rows += [(200 + i, rows[i][1], rows[0][2]) for i in range(10)] + [(300, [0.0] * 8, 10), (301, [1.0] * 8, 100_000)]
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v, _ in rows}
    want = set()
    for i, _, s in rows[50:]:
        alike = [(round(float(unit[i] @ unit[j]), 9), -j) for j, _, t in rows if 0 < s - t <= 400]
        want |= {(i, -max(alike)[1], max(alike)[0])} if alike else set()
    df = spark.createDataFrame(rows, "id long, v array<double>, at long")
    got = within.best_before(df.where("id >= 50"), df, 400, block=block).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want) and any(s < 0.88 for _, _, s in want)


def test_unlike_stories_name_their_match_and_texts_are_read(spark, tmp_path):
    """A story that is not alike enough is new, with its most alike earlier story; the numbers compared are those of props."""
    vec = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.1, 1.0], 9: [0.0, -1.0], 16: [1.0, 0.1], 17: None}
    rows = [(i, None if v is None else v + [0.0] * 62, 0) for i, v in vec.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, '{"k": 7}') for i in (0, 1, 2, 16)], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r for r in runs.semantic_duplicates(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(vec)
    assert got[0]["match_id"] is None and got[17]["match_id"] is None
    assert got[9]["kind"] == "new" and got[9]["match_id"] is not None and got[9]["similarity"] < 0.88
    assert got[16]["kind"] == "duplicate" and got[16]["match_id"] in (0, 1, 2)
