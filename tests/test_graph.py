"""Components against a plain union-find, and what is stored on the way."""

from __future__ import annotations

import os
import random

import pytest

from loomwire import storage
from loomwire.operators import graph
from loomwire.operators.graph import components, extended
from loomwire.storage import discard, stored


def test_components_are_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(3, 3)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {(x, find(x)) for x in parent}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_extended_components_are_those_of_all_edges(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(80)]
    further = [(rng.randrange(260), rng.randrange(260)) for _ in range(40)] + [(300, 301), (5, 5)]
    make = lambda rows: stored(spark.createDataFrame(rows, "a long, b long"))
    known = components(make(edges))
    want = {tuple(r) for r in components(make(edges + further)).collect()}
    got = [tuple(r) for r in extended(known, make(further)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in extended(known, make([])).collect()} == {tuple(r) for r in known.collect()}


def test_rounds_leave_one_folder(spark, tmp_path, monkeypatch):
    at = str(tmp_path)  # a folder that no other session writes to
    monkeypatch.setattr(storage, "shared_dir", lambda _: at)
    before = set(os.listdir(at))
    out = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert len(set(os.listdir(at)) - before) == 1
    discard(out)
    assert set(os.listdir(at)) == before
    kept = stored(spark.range(3))
    assert kept.count() == 3
