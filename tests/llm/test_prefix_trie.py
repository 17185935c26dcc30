"""Operator 12 against plain Python, over conversations with long paths, copies, ties and gaps."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from loomwire.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as rows of the query, from nested dictionaries of plain lists."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        source = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(turns.get(source, [])[:h]) + tuple(own[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        at = ",".join(str(c) for c in sorted(c for c in m if paths[c] == n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), sum(x not in kids for x in below), sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(at.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(seed):
    rng = random.Random(seed)
    texts = ["", " ", "one two", "one\ttwo\x0bthree", "a\xa0b c", None, "漢 字", "x" * 3000]
    rows = []
    for c in [*range(0, 90), 1000, 1020, 1021, 5_000_000_000, -20, -21, -5]:
        if rng.random() < 0.15:
            continue
        kind = rng.random()
        n = rng.randint(1, 7) if kind < 0.8 else 0 if kind < 0.85 else rng.randint(30, 60)
        start = rng.choice([0, 0, 5, None])
        for t in range(n):
            rows.append((c, None if start is None and t == 0 else (start or 0) + t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", texts[t % 3] if rng.random() < 0.8 else rng.choice(texts)))
            if rng.random() < 0.05:
                rows.append(rows[-1])
                rows.append((*rows[-1][:3], "tie"))
    copies = [("user", "hi there"), ("assistant", "hello"), ("user", "bye now")]
    rows += [(2000 + c, t, *x) for c in range(120) for t, x in enumerate(copies)]
    return [*rows, (None, 0, "user", "no id")]


@pytest.mark.parametrize("small", [False, True])
def test_nodes_equal_brute_force(spark, monkeypatch, small):
    if small:  # many segments, shards, blocks and end lists
        for name, value in (("BLOCK", 3), ("IDS", 7)):
            monkeypatch.setattr(prefix_trie, name, value)
        monkeypatch.setattr(prefix_trie.segments, "__defaults__", (2,))
        monkeypatch.setattr(prefix_trie.shards, "__defaults__", (5,))
    rows = rows_of(12)
    got = prefix_trie.build(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == brute(rows)


def test_members_without_turns_end_at_the_root(spark):
    # 21 loses its only turn to a source that isn't there
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = prefix_trie.build(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)).collect()
    assert [tuple(rows[0][x] for x in COLUMNS)] == brute([(c, 0, "user", "x")])
    assert (rows[0]["depth"], rows[0]["n_convs"], rows[0]["n_children"], rows[0]["n_leaves"]) == (0, 1, 0, 1)
    assert rows[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_double_array_holds_its_sequences_and_no_other():
    rng = random.Random(3)
    for _ in range(300):
        paths = sorted({tuple(rng.randrange(rng.choice([3, 40])) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 80))})
        trie = prefix_trie.DoubleArray([list(p) for p in paths])
        states = {}
        for p in paths:
            for d, s in enumerate(trie.walk(list(p)), 1):
                assert states.setdefault(s, p[:d]) == p[:d]
            assert d == len(p)
        prefixes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
        assert len(states) == len(prefixes)
        for _ in range(50):
            q = [rng.randrange(41) for _ in range(4)]
            deepest = max((d for d in range(5) if d == 0 or tuple(q[:d]) in prefixes), default=0)
            assert len(list(trie.walk(q))) == deepest


def test_a_common_first_turn_is_dealt_to_several_shards(spark):
    """A prefix that all conversations share doesn't put them into one task, and its node is merged."""
    rows = [(c, t, "user", "first" if t == 0 else f"{c} {t}") for c in range(3000, 5000) for t in range(3)]
    turns = prefix_trie.stored(prefix_trie.keyed(spark.createDataFrame([(c, t + 1, f"{r}{x}".encode(), 1) for c, t, r, x in rows], "conv_id long, d long, t binary, w long")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = prefix_trie.stored(prefix_trie.shards(prefix_trie.segments(turns)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = nodes.where("depth = 1").collect()
    assert len(first) > 3
    assert max(r["n_convs"] for r in first) < 1000
    assert [r["n_convs"] for r in prefix_trie.merged(nodes).where("depth = 1").collect()] == [2000]
