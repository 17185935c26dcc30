"""The outbox: each signal is announced once, over restarts, new streams and sweeps."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from loomwire.streaming import outbox

AT = datetime(2024, 3, 1)


def signals(spark, ids, kind="weak_signal"):
    return spark.createDataFrame([(str(i), kind, AT + timedelta(minutes=100 - i), "c", None, f"t{i}", 0.5) for i in ids], outbox.SIGNAL)


@pytest.fixture
def box(spark, tmp_path):
    path, into, told = str(tmp_path / "box"), outbox.announced(spark, str(tmp_path / "state")), []

    def run(checkpoint):
        lines = spark.readStream.schema(outbox.LINES).text(path)
        sink = outbox.announcing(into, lambda new: told.extend(r["signal_id"] for r in new.collect()))
        lines.writeStream.option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()

    return path, into, told, run


def test_two_runs_over_one_outbox_announce_once(spark, box):
    path, into, told, run = box
    outbox.append(signals(spark, range(5)), path)
    run("a")
    run("a")
    outbox.append(signals(spark, range(3, 8)), path)  # two of them again
    run("a")
    run("b")  # another stream from the beginning
    assert sorted(told) == [str(i) for i in range(8)]
    assert into.table("announced").count() == 8
    assert len(into.state()["batches"]) == 2


def test_a_sweep_takes_the_oldest_and_then_the_rest(spark, box):
    path, into, told, run = box
    outbox.append(signals(spark, range(4)), path)
    run("a")
    outbox.append(signals(spark, range(4, 10)), path)
    late = []
    tell = lambda new: late.extend(r["signal_id"] for r in new.orderBy("created_at").collect())
    assert [outbox.sweep(spark, path, into, 4, tell) for _ in range(3)] == [4, 2, 0]
    assert late == ["9", "8", "7", "6", "5", "4"]
    run("a")
    assert sorted(told) == ["0", "1", "2", "3"]
    assert {r["signal_id"] for r in into.table("announced").where("swept").collect()} == set(late)


def test_lines_that_are_no_signals_are_kept_apart(spark, box):
    path, into, told, run = box
    outbox.append(signals(spark, [1]), path)
    outbox.append(signals(spark, [2], "gossip"), path)
    outbox.append(signals(spark, [3]).withColumn("cluster_id", outbox.F.lit(None).cast("string")), path)
    spark.createDataFrame([("{broken",), ("",), ('{"kind": "weak_signal"}',)], "value string").write.mode("append").text(path)
    run("a")
    assert told == ["1"]
    assert sorted(r["reason"] for r in into.table("rejected").collect()) == ["no signal id", "no signal id", "no signal id", "nothing to refer to", "unknown kind"]
