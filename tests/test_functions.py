"""Pinned expectations of single functions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwire.functions import text, triage
from loomwire.operators import ahp, dedup, merge, trends, weak
from loomwire.sources.html import main_text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v)
    return df.select(column.alias("x")).first()[0]


def numbers(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def counts(xs):
    return F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")


@pytest.mark.parametrize(("at", "hour"), [("05:59", 0), ("06:00", 6), ("13:30", 12), ("23:59", 18)])
def test_window_start(spark, at, hour):
    assert one(spark, trends.window_start(F.lit(f"2026-08-20 {at}:00").cast("timestamp"))) == datetime(2026, 8, 20, hour)


def test_smoothing_and_differences(spark):
    moves = lambda xs: one(spark, trends.motion(numbers(xs), 6))
    assert [m["frequency"] for m in moves([5, 5, 5])] == pytest.approx([5, 5, 5])
    assert [m["velocity"] for m in moves([5, 5, 5])] == pytest.approx([0, 0, 0], abs=1e-12)
    d = 5 / 7
    f = (2 + d) / (1 + d)
    first, second = moves([1, 2])
    assert (first["frequency"], first["velocity"], first["acceleration"]) == (1, 0, 0)
    assert second["frequency"] == pytest.approx(f)
    assert second["velocity"] == pytest.approx(f - 1)
    # the velocities 0 and f - 1 smoothed, their difference, and that smoothed
    s = (f - 1) / (1 + d)
    assert second["acceleration"] == pytest.approx(s / (1 + d))
    assert moves([]) == []


def test_scores_against_earlier_values(spark):
    xs = [1.0, 1.0, 1.0, 4.0, 2.0]
    got = one(spark, trends.unusual(F.transform(numbers(xs), lambda x: F.struct(x.alias("frequency"), F.lit(0.0).alias("velocity"), (-x).alias("acceleration")))))
    assert [g["z_frequency"] for g in got[:3]] == [None, None, 0.0]
    assert got[3]["z_frequency"] == 0.0  # nothing has moved before, so nothing can be told
    sd = (((0.75) ** 2 * 3 + 2.25**2) / 3) ** 0.5
    assert got[4]["z_frequency"] == pytest.approx((2 - 1.75) / sd)
    assert got[4]["z_acceleration"] == pytest.approx(-got[4]["z_frequency"])
    assert [g["z_velocity"] for g in got] == [None, None, 0.0, 0.0, 0.0]


def test_burst(spark):
    burst = lambda xs: one(spark, weak.burst(counts(xs)))
    for xs in ([], [5], [1, 2], [0] * 9, [3] * 12):
        assert burst(xs) == 0
    assert burst([0, 0, 1, 0, 1, 0, 0, 12, 15, 11]) == pytest.approx(0.3)


def test_combined(spark):
    c = lambda *x: one(spark, weak.combined(*[F.lit(v) for v in x]))
    assert c(1.0, 1.0, 1.0, 1.0) == pytest.approx(1.0)
    assert c(0.9, 0.5, 0.2, 1.0) == pytest.approx(0.57)
    assert c(1.0, 1.0, 1.0, 0.3) == pytest.approx(0.3)


def test_shingles_and_numbers(spark):
    assert sorted(one(spark, text.shingles(F.lit("abcdefg")))) == ["abcde", "bcdef", "cdefg"]
    assert one(spark, text.shingles(F.lit("abc"))) == ["abc"]
    assert one(spark, text.shingles(F.lit(""))) == []
    assert one(spark, text.numbers(F.lit("12 and ๓๔, or 12."))) == ["12", "๓๔"]


def test_event_time(spark):
    want = datetime(2026, 8, 20, 7, 30)
    for s in ("2026-08-20T14:30:00+07:00", "2026-08-20T07:30:00Z", "2026-08-20 14:30:00"):
        assert one(spark, text.event_time(F.lit(s))) == want
    assert one(spark, text.event_time(F.lit("2026-08-20"))) == datetime(2026, 8, 19, 17)
    assert one(spark, text.event_time(F.lit("soon"))) is None


def test_clamps(spark):
    assert one(spark, text.clamp(F.lit("nan"), 0.0, 10.0, 10.0)) == 10.0
    assert one(spark, text.confidence(F.lit("7"))) == 1.0
    assert one(spark, text.confidence(F.lit("junk"))) == 0.0


def test_lists(spark):
    xs = F.array(F.lit(" a"), F.lit("b"), F.lit("a"), F.lit(""), F.lit("c"))
    assert one(spark, text.list_of(xs, ["a", "c"], 3)) == ["a", "c"]


def test_triage(spark):
    from dataclasses import replace

    from loomwire.params import DEFAULTS, DIMENSIONS

    row = spark.range(1).select(*[F.lit(5.0).alias(d) for d in DIMENSIONS])
    assert triage.scored(row, replace(DEFAULTS, sensitivity=0.1)).first()["total"] == 7.5
    assert triage.scored(row.withColumn("sensitivity", F.lit(0.0))).first()["total"] == 5.0
    high = row.withColumn("urgency", F.lit(9.0))
    assert triage.scored(high).first()["verdict"] == "PRIORITY"


def test_delivery(spark):
    delays = [one(spark, merge.next_delay(F.lit(n))) for n in range(6)]
    assert delays == [None, 30, 120, 600, 3600, None]
    assert [one(spark, merge.outcome(F.lit(c))) for c in (202, 503, 429, 404)] == ["delivered", "pending", "pending", "failed"]


def test_classify(spark):
    kind = lambda ta, tb, a, b: one(spark, dedup.classify(F.lit(ta), F.lit(tb), F.lit(a), F.lit(b)))
    assert kind(None, None, "12 dead", "13 dead") == "update"
    assert kind("2026-01-01", None, "x", "x") == "update"
    assert kind(None, None, "the 12 dead", "12 are dead") == "duplicate"


def test_ahp_recovers_neutral(spark):
    alternatives = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "force int, pos int")
    none = spark.createDataFrame([], "force int, i int, j int, i_wins boolean")
    rows = ahp.impacts(ahp.matrices(alternatives, none)).orderBy("pos").collect()
    assert [r["weight"] for r in rows] == pytest.approx([1 / 3] * 3)
    assert rows[0]["ratio"] == pytest.approx(0)
    cyclic = spark.createDataFrame([(1, 0, 1, True), (1, 1, 2, True), (1, 0, 2, False)], "force int, i int, j int, i_wins boolean")
    assert ahp.impacts(ahp.matrices(alternatives, cyclic)).first()["ratio"] == pytest.approx(0.431, abs=1e-3)


def test_main_text():
    body = "word " * 60
    assert main_text(f"<body><nav>menu</nav><article><p>{body}</p></article></body>") == body.strip()
    assert main_text("<body><p>short</p><script>x</script></body>") == "short"
    assert main_text(None) == ""
