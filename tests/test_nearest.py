"""The blocked neighbour search against brute force, and what it writes."""

from __future__ import annotations

import numpy as np
import pytest

from loomwire.operators import vectors


@pytest.mark.parametrize(("k", "before", "floor"), [(1, None, None), (3, None, None), (2, 40, 0.1), (1000, None, 0.3)])
def test_each_vector_is_written_once_and_the_result_is_exact(spark, monkeypatch, k, before, floor):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 4)).round(2)
    v[100:140] = v[:40]  # ties
    at = rng.integers(0, 100, 900)
    rows = spark.createDataFrame([(i, v[i].tolist(), int(at[i])) for i in range(900)], "id long, v array<double>, at long")
    kept = []
    monkeypatch.setattr(vectors, "stored", lambda df, f=vectors.stored: kept.append(f(df)) or kept[-1])
    sizes = []
    monkeypatch.setattr(vectors, "discard", lambda *t, f=vectors.discard: (sizes.extend(sum(len(r["ids"]) // 8 for r in x.select("ids").collect()) for x in t), f(*t)))
    got = vectors.nearest(rows.where("id < 300").withColumnRenamed("id", "query_id"), rows, k, block=64, before=before, floor=floor).collect()
    assert sizes == [300, 900]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u[:300] @ u.T, 9)
    want = []
    for q in range(300):
        fit = [(-s[q, i], i) for i in range(900) if i != q and (not before or 0 < at[q] - at[i] <= before) and (floor is None or s[q, i] >= floor)]
        want += [(q, p, i, -x) for p, (x, i) in enumerate(sorted(fit)[:k], 1)]
    assert [(r["query_id"], r["place"], r["id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["place"]))] == [w[:3] for w in want]
    assert [r["similarity"] for r in sorted(got, key=lambda r: (r["query_id"], r["place"]))] == pytest.approx([w[3] for w in want], abs=2e-9)
