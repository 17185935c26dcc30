from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomwire.sources import feeds, sinks


def test_json_lines_keep_nulls(spark, tmp_path):
    sinks.write_json_lines(spark.createDataFrame([(1, None)], "a long, b string"), f"{tmp_path}/out")
    assert [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()] == [{"a": 1, "b": None}]


def test_append_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.createDataFrame([(1, "a")], "k long, v string").write.parquet(path)
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k long, v string")
    assert sinks.append_absent(new, path, "k").count() == 1
    assert sinks.append_absent(new, path, "k").count() == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_delivery(spark, tmp_path):
    box = spark.createDataFrame([(1, "p", 0), (2, "p", 0), (3, "p", 4)], "id long, payload string, attempts int")

    def post(rows):
        for r in rows:
            yield r["id"], {1: 202, 2: 503, 3: 503}[r["id"]]

    got = {r["id"]: (r["status"], r["next_delay"]) for r in sinks.deliver(box, post, f"{tmp_path}/sent").collect()}
    assert got == {1: ("delivered", None), 2: ("pending", 30), 3: ("failed", None)}


def test_alert_text(spark):
    row = spark.range(1).select(sinks.alert_text(F.lit("trend"), F.lit("Title"), F.lit(2.5), F.lit("http://x")).alias("t")).first()
    assert row["t"] == "[TREND] Title\nscore 2.50\nhttp://x"


def test_rss_and_search(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title>A &lt;b&gt;bold&lt;/b&gt; story</title><link>http://x/1</link><description>Text</description><pubDate>Thu, 20 Aug 2026 07:30:00 +0000</pubDate></item>"
        "<item><title>no link</title></item></channel></rss>"
    )
    row = feeds.rss(spark, f"{tmp_path}/feed.xml").collect()
    assert [(r["title"], r["url"], r["body"], str(r["published"])) for r in row] == [("A bold story", "http://x/1", "Text", "2026-08-20 07:30:00")]
    (tmp_path / "s.json").write_text('{"query": "q", "results": [{"title": "t", "url": "http://y", "content": "c", "publishedDate": "2026-08-20T07:30:00"}, {"title": "", "url": "z"}]}')
    assert [(r["url"], str(r["published"])) for r in feeds.search_results(spark, f"{tmp_path}/s.json").collect()] == [("http://y", "2026-08-20 07:30:00")]


def test_short_bodies_are_filled(spark):
    a = spark.createDataFrame([("u", "short"), ("v", "x" * 700), ("w", None)], "url string, body string")
    p = spark.createDataFrame([("u", "a longer page"), ("v", "y" * 900)], "url string, body string")
    assert {r["url"]: r["body"] and r["body"][0] for r in feeds.filled(a, p).collect()} == {"u": "a", "v": "x", "w": None}
