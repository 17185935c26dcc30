"""State changes and validation on a few rows, and a stream in two micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwire.operators import desk, views
from loomwire.streaming import ingest


def test_complete_result_is_replaced(spark, tmp_path):
    """Three files at one a trigger: one row for the window, not one for each micro-batch."""
    for i in range(3):
        spark.range(10).select(F.lit("2024-01-01 00:10:00").cast("timestamp").alias("ts"), F.lit("k").alias("key"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    rows = ingest.stream(spark, f"{tmp_path}/in/*.parquet", spark.read.parquet(f"{tmp_path}/in/0.parquet").schema, files=1)
    out = ingest.drained(spark, ingest.tumbling(rows, "ts", "key", "value"), "complete").collect()
    assert [(r["n"], r["total"]) for r in out] == [(30, 30.0)]


def test_articles_without_body_keep_a_status(spark):
    rows = [(1, "s", 0.5, None), (2, "s", 0.5, "x"), (3, "s", 0.5, "x"), (4, "s", 0.5, None)]
    g = spark.createDataFrame(rows, "doc_id long, source string, credibility double, body string").withColumn("passes", F.lit(True)).withColumn("fetched_at", F.current_timestamp())
    assert {r["doc_id"]: r["status"] for r in views.statuses(g).collect()} == {1: "processed", 2: "processed", 3: "duplicate", 4: "processed"}


def test_updates_are_audited_in_order(spark):
    stories = spark.createDataFrame([(1, "old"), (2, "alone")], "event_id long, summary string")
    new = spark.createDataFrame([(1, 5, "later", 12), (1, 3, "first", 11)], "event_id long, at long, summary string, report_id long")
    got = {r["event_id"]: (r["summary"], [u["report_id"] for u in r["event_updates"]]) for r in desk.updated(stories, new).collect()}
    assert got == {1: ("later", [11, 12]), 2: ("alone", [])}


def test_pages_are_clamped(spark):
    rows = spark.range(700).withColumn("kind", F.when(F.col("id") % 2 == 0, "even"))
    assert desk.page(rows, [F.col("id")], 9999).count() == desk.MOST
    assert [r["id"] for r in desk.page(rows, [F.desc("id")], 0, 1, kind="even").collect()] == [696]


def test_replies_never_fail(spark):
    rows = spark.createDataFrame([("junk",), (None,), ('{"actors": ["a", " a ", ""], "confidence": "NaN", "categories": ["x", "y"]}',)], "reply string")
    got = [r["x"] for r in rows.select(desk.extracted(F.col("reply"), ["x"]).alias("x")).collect()]
    assert [(x["actors"], x["categories"], x["summary"], x["confidence"]) for x in got] == [([], [], "", 0.0), ([], [], "", 0.0), (["a"], ["x"], "", 0.0)]


def test_merges_are_refused(spark):
    rows = [("Q1", "Q2", "place", "place"), ("Q1", None, "person", "team"), ("Q1", "Q1", "person", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, s string, t string")
    assert [r[0] for r in df.select(desk.may_merge(F.col("a"), F.col("b"), F.col("s"), F.col("t"))).collect()] == [False, False, True, True]
