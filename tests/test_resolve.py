"""Answers applied to the names that were asked about, plausible candidates, backfill, and migrations up and down."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from loomwire.functions import names
from loomwire.operators import resolve
from loomwire.streaming import migrations

MEMBERS = ["Marta Ruiz", "มาร์ตา รุยซ์ (Marta Ruiz)", "กรมชลประทาน", "RID", "somebody"]


def run(spark, replies):
    groups = spark.createDataFrame([(i, MEMBERS) for i in range(len(replies))], "group_id long, members array<string>")
    answers = spark.createDataFrame(list(enumerate(replies)), "group_id long, reply string")
    out = {}
    for r in resolve.resolutions(groups, answers).orderBy("group_id", "part").collect():
        out.setdefault(r["group_id"], []).append(r)
    return out


def brute(reply):
    """(decided_by, type, confidence, names) of each resolution, in plain Python."""
    try:
        payload = json.loads(reply)
        payload["groups"]
    except (TypeError, ValueError, KeyError):
        return [("rules", "unknown", 0.5, tuple(sorted(MEMBERS)))]
    out, claimed = [], set()
    for g in payload["groups"]:
        picked = {MEMBERS[i] for i in g.get("members", []) if isinstance(i, int) and 0 <= i < len(MEMBERS)} - claimed
        if picked:
            claimed |= picked
            out.append(("llm", g.get("type") if g.get("type") in resolve.TYPES else "unknown", g.get("confidence", 0.5), tuple(sorted(picked))))
    if missed := set(MEMBERS) - claimed:
        out.append(("rules", "unknown", 0.0, tuple(sorted(missed))))
    return out


def test_any_answer_leaves_each_name_in_one_resolution(spark):
    rng = random.Random(6)
    replies = [None, "", "I can't say", '{"groups": [', '{"groups": []}']
    for _ in range(60):
        groups = []
        for _ in range(rng.randint(0, 4)):
            g = {"members": [rng.randint(-2, 8) for _ in range(rng.randint(0, 4))]}
            if rng.random() < 0.8:
                g["type"] = rng.choice([*resolve.TYPES, "dragon"])
            if rng.random() < 0.8:
                g["confidence"] = rng.choice([0.1, 0.75, 1.0])
            groups.append(g)
        replies.append(json.dumps({"groups": groups}))
    got = run(spark, replies)
    for i, reply in enumerate(replies):
        rows = got[i]
        assert sorted(n for r in rows for n in r["mentions"]) == sorted(MEMBERS)
        assert sorted((r["decided_by"], r["type"], r["confidence"], tuple(r["mentions"])) for r in rows) == sorted(brute(reply)), reply


def test_what_a_resolution_says(spark):
    reply = '{"groups": [{"members": [1, 0], "canonical": "Marta", "type": "person", "confidence": 0.9}, {"members": [2], "type": "org", "confidence": 0.74}, {"members": [3], "type": "org", "confidence": 0.75}]}'
    one, two, three, left = sorted(run(spark, [reply])[0], key=lambda r: (r["part"] < 0, r["part"]))
    assert one["canonical"] == "มาร์ตา รุยซ์"
    assert one["aliases"] == ["martaruiz", "มาร์ตารุยซ์"]
    assert (one["risk"], one["needs_review"]) == ("joined_on_bracket", True)
    assert (two["risk"], two["needs_review"]) == (None, True)
    assert (three["risk"], three["needs_review"]) == (None, False)
    assert (left["mentions"], left["confidence"], left["risk"], left["needs_review"]) == (["somebody"], 0.0, "names_dropped", True)


def test_works_only_for_the_unknown(spark):
    rows = [("Cambodia", "country", "place"), ("Cambodia", "Song by someone", "place"), ("Song", None, "unknown"), ("A SONG", "x", None), (None, None, "person")]
    df = spark.createDataFrame(rows, "label string, description string, entity_type string")
    got = {(r["label"], r["description"]) for r in resolve.plausible(df, ["song", "film"]).collect()}
    assert got == {("Cambodia", "country"), ("Song", None), ("A SONG", "x"), (None, None)}


def test_backfill_takes_the_most_mentioned_name_once(spark):
    e = spark.createDataFrame([(1, "a", 5, "pending"), (2, "a", 9, None), (3, "b", 7, "linked"), (4, "c", 1, "pending"), (5, "d", 2, "pending")], "entity_id long, name string, mention_count long, qid_status string")
    done = spark.createDataFrame([(5,)], "entity_id long")
    assert [r["entity_id"] for r in resolve.backfill(e, done, 5).collect()] == [2, 4]
    assert [r["entity_id"] for r in resolve.backfill(e, done, 1).collect()] == [2]


def test_composed_leaves_ascii_and_nulls(spark):
    rows = spark.createDataFrame([("abc",), (None,), ("José",)], "t string")
    assert [r["c"] for r in rows.select(names.composed("t").alias("c")).collect()] == ["abc", None, "José"]


def test_up_and_down_keeps_what_each_version_knows(spark, tmp_path):
    store = migrations.Store(spark, str(tmp_path), migrations.STEPS)
    entities, verdicts = spark.createDataFrame([(1, "Q1"), (2, None), (3, "Q3")], "entity_id long, qid string"), spark.createDataFrame([(1, "off_topic"), (2, "true_signal"), (3, None)], "id long, verdict string")
    store.put({"entities": entities, "verdicts": verdicts})
    assert store.migrate() == ["link_states", "off_topic_verdicts", "duplicate_links"]
    assert [r["qid_status"] for r in store.table("entities").orderBy("entity_id").collect()] == ["linked", "pending", "linked"]
    store.put({"entities": store.table("entities").withColumn("qid_status", F.when(F.col("entity_id") == 3, "duplicate").otherwise(F.col("qid_status")))})
    assert store.migrate(1) == ["-duplicate_links", "-off_topic_verdicts"]
    assert [r["qid_status"] for r in store.table("entities").orderBy("entity_id").collect()] == ["linked", "pending", "pending"]
    assert sorted(r["id"] for r in store.table("verdicts").collect()) == [2, 3]
    assert store.migrate(0) == ["-link_states"]
    assert store.table("entities").columns == ["entity_id", "qid"]
    assert store.migrate() == ["link_states", "off_topic_verdicts", "duplicate_links"]
    assert store.migrate() == []


def test_a_step_that_fails_leaves_the_version_before(spark, tmp_path):
    broken = migrations.Step("broken", {"t": lambda t: t.withColumn("x", F.raise_error(F.lit("no")))})
    store = migrations.Store(spark, str(tmp_path), [migrations.Step("good", {"t": lambda t: t.withColumn("y", F.lit(1))}), broken])
    store.put({"t": spark.range(3)})
    try:
        store.migrate()
    except Exception as e:  # noqa: BLE001
        assert "no" in str(e)
    assert store.state()["version"] == 1
    assert store.table("t").columns == ["id", "y"]
