"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwire import llm

NAMES = ["t", "n", "s", "key", "line", "m", "root", "score", "label", "hits", "n_words", "hit_items", "shard", "slot", "size", "host", "path", "template", "position", "example", "v", "g", "c", "ids", "_rest", "_f", "_id", "_gone", "_d", "_t", "_text", "_words"]
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
TEXTS = [None, "", " ", "\n\n", "x", "one line that is long enough to be indexed as a line\nshort", "one line that is long enough to be indexed as a line\nshort", LONG, LONG + "omega", "é漢字 😀 " * 30, "A!! B!! C!!", "a\x00b", "<|endoftext|> and more"]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
DOCS = [(i, t, None if i % 3 else "en", None if i % 2 else "src0", None if i % 4 else 5) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (None, None, None, None, None), (3, "another text with the same id", "en", "s", 1), (3, "another text with the same id", "en", "s", 1)]
NAN, INF = float("nan"), float("inf")
ROWS = {
    "documents": DOCS,
    "embeddings": [(i, [0.5, -0.25, float(i % 3)], i % 2) for i in range(45)] + [(20, [0.5, 0.5, 0.5], 1), (20, [0.5, 0.5, 0.5], 1), (50, None, None), (51, [None, 1.0, 1.0], 0), (52, [NAN, 1.0, 1.0], 0), (53, [INF, 1.0, 1.0], 0), (60, [], 0), (61, [1.0], 0), (None, [1.0, 1.0, 1.0], None)],
    "pages": [(i, u, None) for i, u in enumerate(["http://a.com/x/1", "http://a.com/x/1", None, "", "nothing", "http://", "http:///p", "https://B.NET/es/" + "y" * 5000, "http://a.com/a/b/c/d/e/f?x#y", "x://h?q://z"])] + [(None, "http://a.com/x/2", "h")],
    "benchmark": [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha"), (2, "x"), (2, "x"), (None, "short"), (3, None), (4, ""), (5, "!!!")],
    "labels": [(0, 1, 0), (1, None, None), (None, 1, 0), (2, 0, 1), (2, 1, 0), (99, 1, 1)],
    "conversations": [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, "assistant", "early"), (None, 0, None, None), (None, 1, "assistant", "<|im_end|>"), (2, 0, "role\nwith\\line", LONG)],
}


def write(spark, at, rows):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows[name], schema)
        have = set(df.columns)
        df.select("*", *[F.lit("clash").alias(c) for c in NAMES if c not in have]).coalesce(2).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def weird(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("weird"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {k: [] for k in SCHEMAS})


def lines(text):
    return [x for x in (text or "").split("\n") if x.strip(" ")]


EXPECTED = {
    "op1_chat_format": 4, "op2_line_dedup": sum(len(lines(r[1])) for r in DOCS), "op4_jump_sharding": len(DOCS), "op5_decontaminate": len(DOCS), "op7_order_minhash": len(DOCS), "op8_url_templates": len(ROWS["pages"]),
    "op9_rule_quality": len(DOCS), "op10_license_digest": len(DOCS), "op11_anchor_codes": 50, "op13_bpe_prefix": len(DOCS),
}


@pytest.mark.parametrize("name", list(llm.registered()))
def test_odd_rows(spark, weird, name):
    rows = llm.registered()[name][0](spark, weird).collect()
    if name in EXPECTED:
        assert len(rows) == EXPECTED[name]
    assert rows


@pytest.mark.parametrize("name", list(llm.registered()))
def test_empty_tables(spark, empty, name):
    assert llm.registered()[name][0](spark, empty).count() == (1 if name == "op1_chat_format" else 0)


def test_slots_have_no_gap(spark, weird):
    by = {}
    for r in llm.registered()["op4_jump_sharding"][0](spark, weird).collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_packing_covers_every_row(spark, weird):
    rows = llm.registered()["op3_harmonic_packing"][0](spark, weird).collect()
    assert sum(r["start"] == 0 for r in rows) == len(DOCS)


def test_equal_texts_share_a_class(spark, weird):
    got = {}
    for r in llm.registered()["op7_order_minhash"][0](spark, weird).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert got[6] == {5}
    assert got[8] == {7}
    assert got[0] == got[1] == {0}


def test_searches_skip_what_takes_no_part(spark, weird):
    rows = llm.registered()["op6_block_topk"][0](spark, weird).collect()
    assert {r["query_id"] for r in rows} == {0, 20, 40, 60}
    assert not {r["vec_id"] for r in rows} & {50, 51, 52, 53, None}


@pytest.mark.parametrize("which", ["weird", "empty"])
def test_pipeline_stages(spark, request, which):
    at = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, stages = docs.columns, corpus_pipeline.STAGES
    for name, stage in stages:
        out = stage(spark, docs, at)
        rows = out.count()
        assert rows == 0 if which == "empty" else rows > 0 or name == "quality", name
        if name != stages[-1][0]:
            assert out.columns == columns
            # the stage alone is looked at: every stage gets all documents


def test_pipeline_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = {r["doc_id"] for r in stage(spark, docs, sf).select("doc_id").collect()}
        assert len(kept) > 0.75 * docs.count(), name
        assert "doc_id" in docs.columns
