"""Operators 11 and 13 against brute force, the tokenizers library and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwire.llm import anchor_codes, bpe_prefix

# 11


@pytest.mark.parametrize(("n", "d", "spread"), [(4096, 4, 30), (500, 4, 2), (1, 3, 5), (700, 4, 0.01), (1500, 1, 1000), (900, 8, 100)])
def test_balls_hold_their_points_and_own_them_exactly(n, d, spread):
    rng = np.random.default_rng(n)
    points = np.floor(rng.normal(0, spread, (n, d))).astype(np.int64)
    t, place = anchor_codes.tree(points)
    assert (t.points[place] == points).all()
    for i in range(len(t.radius)):
        inside = slice(t.begin[i], t.end[i])
        p, w = t.points[inside], t.weights[inside]
        assert t.count[i] == w.sum()
        assert (t.total[i] == (p * w[:, None]).sum(axis=0)).all()
        assert ((p - t.pivot[i]) ** 2).sum(axis=1).max() <= t.radius[i] ** 2 * (1 + 1e-9)
    for entries in (points[rng.integers(0, n, 64)], points[:1], np.repeat(points[:3], 5, axis=0)):
        owner, total, count, _ = anchor_codes.assign(t, entries)
        want = anchor_codes._squares(points, entries).argmin(axis=1)
        assert (owner[place] == want).all()
        assert (np.bincount(want, minlength=len(entries)) == count).all()
        assert all((total[e] == points[want == e].sum(axis=0)).all() for e in range(len(entries)))


def test_wide_apart_groups_are_owned_whole():
    rng = np.random.default_rng(3)
    centres = rng.integers(-10**5, 10**5, (16, 4))
    points = np.concatenate([c + rng.integers(-20, 20, (250, 4)) for c in centres])
    t, _ = anchor_codes.tree(points)
    assert anchor_codes.assign(t, centres)[3] < len(t.points) / 20


def brute(rows, parts, entries, rounds):
    """Plain Python: (vec_id, code, error) in the order of rows, and the codebooks."""
    width = max(1, -(-max((len(v) for _, v in rows), default=0) // parts)) * parts
    d = width // parts
    cut = [[tuple((list(v) + [0] * width)[p * d : (p + 1) * d]) for p in range(parts)] for _, v in rows]
    start = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        code = [[min(range(len(books[p])), key=lambda e, x=x, p=p: (far(x, books[p][e]), e)) for p, x in enumerate(c)] for c in cut]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [c[p] for c, k in zip(cut, code, strict=True) if k[p] == e]
                    if mine:
                        books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    return [(bytes(k), sum(far(x, books[p][k[p]]) for p, x in enumerate(c))) for c, k in zip(cut, code, strict=True)], books


def test_codes_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i if i % 9 else None, [rng.randint(-40, 40) for _ in range(rng.choice([8, 8, 8, 5, 0]))]) for i in range(300)]
    rows += [(7, [1] * 8)] * 60
    df = spark.createDataFrame([(i, None if i is None or i % 4 == 0 else i % 3, v) for i, v in rows], "vec_id long, label int, v array<long>").repartition(5)
    coded, books = anchor_codes.encode(df, parts=4, entries=20, rounds=3, block=50)
    want, book = brute(rows, 4, 20, 3)
    assert books.tolist() == [[list(e) for e in p] for p in book]
    got = sorted(((r["vec_id"], bytes(r["codes"]), r["error"]) for r in coded.collect()), key=repr)
    assert got == sorted(((i, c, e) for (i, _), (c, e) in zip(rows, want, strict=True)), key=repr)
    sums = {}
    for (i, _), (_, e) in zip(rows, want, strict=True):
        sums[k] = sums.get(k := None if i is None or i % 4 == 0 else i % 3, 0) + e
    assert {r["label"]: r["label_error"] for r in anchor_codes.by_label(coded).select("label", "label_error").distinct().collect()} == sums


def test_components_that_leave_a_long_are_an_error(spark):
    df = anchor_codes.quantised(spark.createDataFrame([(1, [1e30] * 16, 0)], "vec_id long, embedding array<double>, label int"))
    with pytest.raises(ValueError, match="beyond a long"):
        anchor_codes.encode(df)


# 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_prefix.byte_bpe())


@pytest.fixture(scope="module")
def encoder():
    return bpe_prefix.Encoder(bpe_prefix.byte_bpe())


PIECES = ["a", "aa", "the", "  ", " ", "\n", "\t", "é", "漢", "😀", "1", "22", "'s", "'ll", "!", "<|endoftext|>", "e", "r", "in", "ing", "²", "Ⅷ", "_", "\x00", "ับ", "\xa0", "zzz", "=", "-----"]


def test_ids_and_texts_equal_the_library(library, encoder):
    rng = random.Random(13)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["a" * 30_000 + "b==" * 9000, ""]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(encoder.encode(text), "<i4")
        assert got.tolist() == want
        assert encoder.decode(got.astype(np.int64)) == library.decode(want, skip_special_tokens=False) == text


def test_words_equal_the_library(library, encoder):
    rng = random.Random(14)
    for _ in range(5000):
        word = "".join(rng.choice("aeinrstTh") for _ in range(rng.randint(1, 60)))
        assert encoder.word(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_forgotten_words_are_encoded_again(monkeypatch, library):
    monkeypatch.setattr(bpe_prefix, "REMEMBERED", 3)
    monkeypatch.setattr(bpe_prefix, "SLICE", 2)
    encoder = bpe_prefix.Encoder(bpe_prefix.byte_bpe())
    text = "one two three one four five six one two seven " * 3
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.young) <= 5


def test_automaton_lists_the_suffixes_among_its_strings():
    rng = random.Random(15)
    for _ in range(200):
        strings = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(12)} | {b"a", b"b", b"c"})
        rng.shuffle(strings)
        auto = bpe_prefix.SuffixAutomaton()
        for i, s in enumerate(strings):
            auto.add(s, i)
        auto.close()
        text, state, n = bytes(rng.choice(b"abc") for _ in range(30)), 0, 0
        for at, byte in enumerate(text, 1):
            while (to := auto.go.get(state << 8 | byte)) is None:
                state = auto.link[state]
                n = auto.length[state]
            state, n = to, n + 1
            found = [m for k, m in auto.ends[state] if k <= n]
            assert [strings[m] for m in found] == sorted((s for s in strings if text[:at].endswith(s)), key=len, reverse=True)


def test_every_document_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe_prefix.query(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decoding_leaves_out_nulls_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [64, None, 10**6, -1, 65]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe_prefix.decode(rows, bpe_prefix.byte_bpe()).select("doc_id", "text").collect()}
    assert got == {1: "ab", 2: "", 3: ""}


def test_files_with_more_than_merges_are_refused(tmp_path):
    import json

    spec = json.load(open(bpe_prefix.byte_bpe(), encoding="utf-8"))
    for part, change in (("model", {"dropout": 0.1}), ("model", {"ignore_merges": True}), ("pre_tokenizer", {"add_prefix_space": True})):
        other = json.loads(json.dumps(spec))
        other[part] |= change
        (tmp_path / "t.json").write_text(json.dumps(other))
        with pytest.raises(ValueError, match="byte-level"):
            bpe_prefix.Encoder(str(tmp_path / "t.json"))


def test_texts_of_many_rows_keep_their_order(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    back = bpe_prefix.decode(bpe_prefix.encode(rows, bpe_prefix.byte_bpe()), bpe_prefix.byte_bpe())
    assert back.join(rows.withColumnRenamed("text", "was"), "doc_id").where("text = was").count() == 3000
