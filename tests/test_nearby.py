"""Near-duplicate state of a stream: its horizon, its size, and what it says against plain Python."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import numpy as np

from loomwire.operators import dedup
from loomwire.params import DEFAULTS as P
from loomwire.streaming import ingest, nearby

START = datetime(2024, 3, 1)
SCHEMA = "article_id long, text string, at timestamp"


def text(seed):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(10_000)}" for _ in range(80))


def play(spark, tmp_path, batches):
    """The rows that each landed file gives, in its own micro-batch, and the state's size after it."""
    landed, check = str(tmp_path / "landed"), str(tmp_path / "check")
    schema = spark.createDataFrame([], SCHEMA).schema
    out, sizes = [], []

    def run():
        rows = nearby.near_duplicates(spark, ingest.stream(spark, landed, schema, files=1))
        query = rows.writeStream.outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).start()
        query.awaitTermination()
        sizes.append(sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in (json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p)["stateOperators"]))

    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        run()
    return out, sizes


def test_a_copy_within_the_horizon_is_found_and_a_later_one_is_not(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    day = lambda d: START + timedelta(days=d)
    copied = text(1)
    batches = [
        [(1, copied, day(0)), (2, text(2), day(0)), *[(100 + i, text(100 + i), day(0)) for i in range(20)]],
        [(3, copied, day(6)), (4, text(4), day(6))],
        [(5, copied, day(8))],
        [(6, copied, day(8) + timedelta(hours=1)), (7, text(7), day(30))],
        [(8, text(8), day(30))],
    ]
    try:
        out, sizes = play(spark, tmp_path, batches)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {(a, b) for a, b, _ in out} == {(3, 1), (6, 5)}
    assert len(out) == 2 * dedup.BANDS
    assert sizes[-1] < sizes[0] / 2


def test_every_pair_that_shares_a_band_is_found(spark, tmp_path):
    """One batch of edited copies: of each article the duplicates that a band's own order gives."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        base = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.6 else text(1000 + i)
        words = base.split()
        words[rng.randrange(len(words))] = "changed" if rng.random() < 0.7 else words[0]
        rows.append((i, " ".join(words), START + timedelta(hours=rng.randrange(300))))
    out, _ = play(spark, tmp_path, [rows])
    with np.errstate(over="ignore"):
        sigs = {i: np.array(dedup.signature(t, P.shingle, P.permutations)) for i, t, _ in rows}
    width, want = P.permutations // dedup.BANDS, set()
    for k in range(0, P.permutations, width):
        kept = []
        for i, _, at in sorted(rows, key=lambda r: (r[2], r[0])):
            near = [(-float((sigs[i] == sigs[j]).mean()), j) for j, t in kept if (sigs[i][k : k + width] == sigs[j][k : k + width]).all() and at - t <= timedelta(days=P.dedup_days)]
            near = min((n for n in near if -n[0] >= P.jaccard), default=None)
            if near:
                want.add((i, near[1]))
            else:
                kept.append((i, at))
    assert {(a, b) for a, b, _ in out} == want
    assert len(want) > 10
