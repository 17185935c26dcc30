"""Exact top-k search with block-at-a-time pruning (operator 6).

A vector's components are its terms. Candidates are dealt into groups of bounded size, sorted there so that alike
vectors are neighbours, and cut into ranges of documents, the blocks. A block keeps each term's largest and smallest
value, so a query's summed term maxima bound every score in it, and its rows as a forward index. A query takes a
group's blocks by falling bound until the bound is below its kth score; a bound equal to it is still looked at, so ties
are exact. Queries are a stated set, dealt into chunks; a task has one chunk and one group, and Spark merges each
query's group winners by window.

Components are whole numbers held as doubles, which floor(64 * x) is exactly. Products that fit are computed as doubles,
larger ones as Python's integers, so every finite component is scored exactly.

Defined results: a vector that is null or has null or non-finite components (64-fold too) takes no part, nor does a row without a
vec_id; missing components of short vectors count as 0; candidates are all rows whose vec_id is not the query's (rows
that share it are none); equal scores go to the smaller vec_id; repeated candidates are ranked each, repeated queries
once; a score beyond a long is ranked by its true value and returned as the nearest long; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.llm._common import read

K, BLOCK, GROUP_ROWS, CHUNK_ROWS = 20, 64, 8192, 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of every component, of the rows that take part."""
    x = F.transform("embedding", lambda x: x.cast("double") * scale)
    fine = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # from 2**53 on a double is whole as it is, and floor, a long, would end at 2**63
    whole = F.transform(x, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine).select("vec_id", whole.alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's k best rows, best first (places left over have -inf), and the blocks scored."""
    # products of doubles are exact below 2**53 and run in BLAS; larger ones are Python's integers, and their bounds doubles
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < 2**53
    whole = (lambda m: m) if exact else (lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape))
    strongest = np.abs(rows).argmax(axis=1) if rows.shape[1] else np.zeros(len(rows), int)
    sign = np.take_along_axis(rows, strongest[:, None], 1)[:, 0] if rows.shape[1] else np.zeros(len(rows))
    order = np.lexsort((-sign, strongest))
    rows, ids = rows[order], ids[order]
    q, d = whole(queries), whole(rows)
    cuts = range(0, len(d), block)
    high, low = np.stack([rows[i : i + block].max(axis=0) for i in cuts]), np.stack([rows[i : i + block].min(axis=0) for i in cuts])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up @ high.T + down @ low.T
    if not exact:  # rounding must not lower a bound
        bound = bound + (up @ np.abs(high).T - down @ np.abs(low).T) * 2.0**-40
        bound = np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=-np.inf)
    turn = np.argsort(-bound, axis=1, kind="stable")
    best, best_ids, scored = np.full((len(q), k), -np.inf, float if exact else object), np.full((len(q), k), np.iinfo(np.int64).max), 0
    active = np.arange(len(q))
    for r in range(len(high)):
        now = turn[active, r]
        live = (bound[active, now] >= best[active, -1]).astype(bool)
        active, now = active[live], now[live]  # bounds fall, so a query that stops stays stopped
        if not len(active):
            break
        by = np.argsort(now, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(now[by])) + 1):
            at, b = active[part], int(now[part[0]])
            own_ids = np.broadcast_to(ids[b * block : (b + 1) * block], (len(at), len(ids[b * block : (b + 1) * block])))
            scores = q[at] @ d[b * block : (b + 1) * block].T
            scores = np.where(own_ids == query_ids[at, None], -np.inf, scores)
            scored += 1
            s, i = np.concatenate([best[at], scores], axis=1), np.concatenate([best_ids[at], own_ids], axis=1)
            if exact:
                top = np.lexsort((i, -s), axis=1)[:, :k]
            else:
                top = np.array([sorted(range(s.shape[1]), key=lambda c, x=x, y=y: (-x[c], y[c]))[:k] for x, y in zip(s, i, strict=True)])
            best[at], best_ids[at] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    return best, best_ids, scored


def _sortable(scores: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores as longs, those beyond as the nearest long; for these, and the ends of a long, a value that sorts by size."""
    if scores.dtype != object:
        return scores.astype(np.int64), [None] * len(scores)
    wide = [None if _LEAST < s < _MOST else (s + (1 << 2200)).to_bytes(276, "big") for s in scores]
    return np.array([min(max(s, _LEAST), _MOST) for s in scores], np.int64), wide


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score; both inputs have vec_id and v."""
    groups, chunks = max(1, -(-rows.count() // group_rows)), max(1, -(-queries.count() // chunk_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # the sequence number of a repeated id must not matter, so the vector takes part in the deal
    right = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias("g"), spread(chunks).alias("c"))
    left = queries.dropDuplicates().select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("c"), spread(groups).alias("g"))

    def run(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        width = max(qs["v"].map(len).max() if len(qs) else 0, ds["v"].map(len).max() if len(ds) else 0)
        if not len(qs) or not len(ds):
            return pd.DataFrame({"query_id": [], "h": [], "vec_id": [], "score": []}).astype("int64").assign(wide=[])
        s, i, _ = search(_matrix(qs["v"], width), qs["query_id"].to_numpy(), _matrix(ds["v"], width), ds["vec_id"].to_numpy(), k)
        n, keep = s.shape[1], (s > -np.inf).ravel().astype(bool)
        score, wide = _sortable(s.ravel()[keep])
        return pd.DataFrame({"query_id": np.repeat(qs["query_id"].to_numpy(), n)[keep], "h": np.repeat(qs["h"].to_numpy(), n)[keep], "vec_id": i.ravel()[keep], "score": score, "wide": wide})

    found = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(run, "query_id long, h long, vec_id long, score long, wide binary")
    # only scores at the ends of a long have a wide value, so score decides first
    place = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
