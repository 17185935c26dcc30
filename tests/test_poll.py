"""The poll pass: sources of several types in one stream, failures apart, admission, and restarts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomwire.sources import landed
from loomwire.streaming import ingest


def feed(*items):
    rows = "".join(f"<item><title>{t}</title><link>{u}</link><description>{b}</description><pubDate>Thu, 20 Aug 2026 07:30:00 +0000</pubDate></item>" for t, u, b in items)
    return f"<rss><channel><title>feed</title>{rows}</channel></rss>"


def answer(*results):
    return json.dumps({"query": "q", "results": [{"title": t, "url": u, "content": b, "publishedDate": "2026-08-20T07:30:00"} for t, u, b in results]})


@pytest.fixture
def poll(spark, tmp_path):
    spark.dataSource.register(landed.Landed)
    names = {"feed": "rss", "search": "search", "desk": "pushed", "broken": "rss", "odd": "carrier pigeon", "asleep": "rss"}
    sources = [{"name": n, "type": t, "path": str(tmp_path / n), "active": n != "asleep"} for n, t in names.items()]
    root = str(tmp_path / "queue")
    into = ingest.queue(spark, root)

    def land(name, file, text):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / file).write_bytes(text if isinstance(text, bytes) else text.encode())

    def run(pages=None, **options):
        rows = spark.readStream.format("landed").options(sources=json.dumps(sources), root=root, **{k: str(v) for k, v in options.items()}).load()
        query = rows.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").foreachBatch(ingest.enqueue(into, pages)).start()
        query.processAllAvailable()
        query.stop()
        return {r["url"]: r for r in into.table("raw").collect()}

    return into, land, run


def test_types_are_dispatched_and_failures_stop_nobody(spark, poll):
    into, land, run = poll
    land("feed", "001.xml", feed(("One", "http://x/1", "b1"), ("Two", "http://x/2", "b2"), ("", "http://x/none", "")))
    land("search", "001.json", answer(("Three", "http://x/3", "b3"), ("One again", "http://x/1", "other")))
    land("desk", "001.json", "{}")
    land("broken", "001.xml", b"\xff\xfe\xff not text")
    land("broken", "002.xml", "not a feed")
    land("odd", "001", "coo")
    land("asleep", "001.xml", feed(("Never", "http://x/9", "b")))
    got = run(spark.createDataFrame([("http://x/2", "a page that is longer")], "url string, body string"))
    assert set(got) == {"http://x/1", "http://x/2", "http://x/3"}
    assert got["http://x/2"]["body"] == "a page that is longer"
    assert {r["status"] for r in got.values()} == {"queued"}
    assert str(got["http://x/3"]["published"]) == "2026-08-20 07:30:00"
    failures = {r["source"]: (r["files"], r["error"]) for r in into.table("failures").collect()}
    assert failures["broken"][0] == 2
    assert failures["odd"] == (1, "unknown type carrier pigeon")
    assert set(failures) == {"broken", "odd"}


def test_a_restart_goes_on_at_its_offset(spark, poll):
    into, land, run = poll
    land("feed", "001.xml", feed(("One", "http://x/1", "first")))
    assert run()["http://x/1"]["body"] == "first"
    number = into.state()["number"]
    run()
    assert into.state()["number"] == number
    land("feed", "001.xml", feed(("Changed", "http://x/0", "a file that was taken is not read again")))
    land("feed", "002.xml", feed(("One", "http://x/1", "second"), ("Two", "http://x/2", "b")))
    land("search", "001.json", answer(("Three", "http://x/3", "b")))
    got = run()
    assert {u: r["body"] for u, r in got.items()} == {"http://x/1": "first", "http://x/2": "b", "http://x/3": "b"}


def test_a_full_queue_admits_nothing_until_it_is_worked_off(spark, poll):
    into, land, run = poll
    land("feed", "001.xml", feed(*[(f"t{i}", f"http://x/{i}", "b") for i in range(5)]))
    assert len(run(most=3)) == 5
    land("feed", "002.xml", feed(("Late", "http://x/late", "b")))
    assert len(run(most=3)) == 5
    assert into.commit(0, {"raw": into.table("raw").withColumn("status", F.lit("processed"))}, "worker")
    landed.write_depth(into.root, 0)
    got = run(most=3)
    assert len(got) == 6
    assert [u for u, r in got.items() if r["status"] == "queued"] == ["http://x/late"]


def test_few_files_a_batch_and_sources_by_turns(tmp_path):
    sources = []
    for name, n in (("a", 5), ("b", 1)):
        (tmp_path / name).mkdir()
        for i in range(n):
            (tmp_path / name / f"{i:03d}").write_text("x")
        sources.append({"name": name, "type": "rss", "path": str(tmp_path / name)})
    reader = landed.Reader({"sources": json.dumps(sources), "root": str(tmp_path / "r"), "files": "3"})
    start, taken = reader.initialOffset(), []
    for _ in range(4):
        end = reader.latestOffset()
        taken.append([p.path[len(str(tmp_path)) + 1 :] for p in reader.partitions(start, end)])
        start = end
    assert taken == [["a/000", "a/001", "b/000"], ["a/002", "a/003", "a/004"], [], []]
    again = landed.Reader({"sources": json.dumps(sources), "root": str(tmp_path / "r")})
    assert again.latestOffset() == start
