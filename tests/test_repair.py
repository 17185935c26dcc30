"""Store repair against a serial pass on random stores, in one round and in many."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwire.operators import repair

SCHEMA = "entity_id long, name string, aliases array<string>, mention_count long, type string, qid string, spelt boolean, related boolean"
FULL = "entity_id long, name string, aliases array<string>, mention_count long, type string, qid string, confidence double, first_seen timestamp, last_seen timestamp, review_status string, risk string"


def store(seed, n=150, pool=120):
    rng = random.Random(seed)
    return [
        (i, f"name {rng.randrange(40)}", sorted({f"a{rng.randrange(pool)}" for _ in range(rng.randint(0, 3))}), rng.randrange(6), rng.choice(["unknown", "unknown", "person", "org", "place"]), rng.choice([None, None, "Q1", "Q2"]), rng.random() < 0.85, rng.random() < 0.9)
        for i in range(n)
    ]


def serial(rows):
    held, state, out = {}, {}, {}
    for i, _, aliases, _, kind, qid, spelt, related in sorted(rows, key=lambda r: (-r[3], r[1], r[0])):
        if not spelt:
            state[i] = [qid, kind]
            for a in aliases:
                held.setdefault(a, i)
            out[i] = ("kept", None)
        elif not related:
            out[i] = ("unrelated_names", None)
        else:
            twin = next((held[a] for a in aliases if a in held), None)
            if twin is None:
                state[i] = [qid, kind]
                for a in aliases:
                    held.setdefault(a, i)
                out[i] = ("kept", None)
                continue
            q, t = state[twin]
            if q and qid and q != qid:
                out[i] = ("different_items", twin)
            elif "person" in (t, kind) and {t, kind} & {"org", "place"}:
                out[i] = ("type_mismatch", twin)
            else:
                state[twin] = [q or qid, kind if t == "unknown" else t]
                for a in aliases:
                    held.setdefault(a, twin)
                out[i] = ("merged", twin)
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 20_000), (2, 40), (3, 7)])
def test_equals_the_serial_pass(spark, seed, chunk):
    rows = store(seed)
    got = {r["entity_id"]: (r["outcome"], r["into"]) for r in repair.decided(spark.createDataFrame(rows, SCHEMA), chunk).collect()}
    want = serial(rows)
    assert got == want
    assert len({o for o, _ in want.values()}) == 5


def test_an_empty_store(spark):
    assert repair.decided(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_and_apply(spark):
    day = lambda d: datetime(2024, 1, d)
    entities = [
        (1, "Marta Ruiz, Minister", ["martaruiz,minister"], 9, "unknown", None, 0.5, day(3), day(9), "auto", None),
        (2, "มาร์ตา รุยซ์", ["x"], 4, "person", "Q7", 0.9, day(1), day(4), "auto", None),
        (3, "mixed", ["one", "two"], 3, "person", "Q9", 0.7, day(2), day(2), "auto", None),
        (4, "Marta Ruiz GmbH", ["z"], 2, "org", None, 0.7, day(2), day(2), "confirmed", "old"),
        (5, "silent", ["kept"], 1, "place", None, 0.1, day(2), day(2), "auto", None),
    ]
    mentions = [(10, 1, "Marta Ruiz, Minister"), (10, 1, "Marta Ruiz"), (11, 2, "มาร์ตา รุยซ์ (Marta Ruiz)"), (10, 2, "Marta Ruiz"), (12, 3, "One Thing"), (12, 3, "Other Thing"), (13, 4, "Marta Ruiz")]
    e, m = spark.createDataFrame(entities, FULL), spark.createDataFrame(mentions, "event_id long, entity_id long, surface string")
    planned = repair.stored(repair.plan(e, m))
    got = {r["entity_id"]: (r["outcome"], r["into"], r["name"]) for r in planned.collect()}
    assert got == {1: ("kept", None, "Marta Ruiz"), 2: ("merged", 1, "มาร์ตา รุยซ์"), 3: ("unrelated_names", None, got[3][2]), 4: ("type_mismatch", 1, "Marta Ruiz"), 5: ("kept", None, "silent")}
    assert e.collect() == spark.createDataFrame(entities, FULL).collect()  # a plan changes nothing
    after, moved = repair.repaired(planned, m)
    rows = {r["entity_id"]: r for r in after.collect()}
    assert set(rows) == {1, 3, 4, 5}
    one = rows[1]
    assert (one["aliases"], one["mention_count"], one["confidence"], one["type"], one["qid"]) == (["martaruiz", "มาร์ตารุยซ์"], 13, 0.9, "person", "Q7")
    assert (one["first_seen"], one["last_seen"]) == (day(1), day(9))
    assert (rows[3]["review_status"], rows[3]["risk"], rows[3]["qid"]) == ("needs_review", "unrelated_names", None)
    assert (rows[4]["review_status"], rows[4]["risk"]) == ("confirmed", "old")  # a person has decided
    assert (rows[5]["aliases"], rows[5]["review_status"]) == (["kept"], "auto")
    links = sorted(map(tuple, moved.select("event_id", "entity_id", "surface").collect()))
    assert links == sorted({(ev, 1 if en == 2 else en, s) for ev, en, s in mentions})


def test_refusal_as_a_column(spark):
    rows = spark.createDataFrame([(q, o, k, t) for q in (None, "Q1") for o in (None, "Q1", "Q2") for k in ("person", "org", "unknown") for t in ("person", "team", "unknown")], "q string, o string, k string, t string")
    for r in rows.withColumn("why", repair.refusal(*map(F.col, "qokt"))).collect():
        assert r["why"] == repair._apart(r["q"], r["o"], r["k"], r["t"])
