"""A shard of the near-duplicate state: one reading and one addition a micro-batch, whatever the number of its bands."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from loomwire.streaming import nearby

DAY = 86_400_000_000


class State:
    def __init__(self):
        self.rows, self.calls, self.timers = [], [], set()

    def getListState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def appendList(self, rows):  # noqa: N802
        self.calls.append("append")
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


def short(values):
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(values)), pa.array([v.tolist() for v in values], pa.list_(pa.int64()))], ["article_id", "sig"])
    return next(nearby._short(iter([batch]))).column("sig").to_pylist()


def test_signatures_keep_every_bit():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 31, (5, 128)) + (rng.integers(0, 128, (5, 128)) << 32)
    for row, sig in zip(v, short(v), strict=True):
        low, high = nearby._halves(sig)
        assert (low.astype(np.int64) + (high.astype(np.int64) << 32) == row).all()


def test_many_bands_are_read_and_kept_at_once_and_go_after_the_horizon():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 31, (3, 128))
    v[2] = v[0]
    v[2, :10] += 1  # 118 of 128 agree
    a, b, c = short(v)
    state = State()
    shard = nearby.Shard(7, 0.85)
    shard.init(state)
    play = lambda rows: pd.concat(shard.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["band", "article_id", "us", "sig"])]), None)).values.tolist()
    assert play([(k, 1, 0, a) for k in range(50)] + [(k, 2, DAY, b) for k in range(50)]) == []
    assert state.calls == ["append"]
    assert len(state.rows) == 100
    assert play([(k, 3, 2 * DAY, c) for k in range(0, 60)]) == [[3, 1, 118 / 128]] * 50
    assert state.calls == ["append", "get", "append"]
    assert play([(0, 4, 7 * DAY + 1, a)]) == []  # a day and a microsecond too late
    for due in sorted(state.timers):
        assert due * 1000 >= 7 * DAY
        list(shard.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda d=due: d)))
        assert all(us + 7 * DAY >= (due - 2 * nearby.STEP_MS) * 1000 for _, _, us, _ in state.rows)
    assert state.rows == []
