"""Vector operators: unit vectors, centroids, medoids, nearest neighbours and stable cluster ids."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.operators.graph import components
from loomwire.storage import discard, stored

BLOCK = 4096
#: Queries whose scores are held at once, in `nearest`.
FEW = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    # inside a lambda the norm would be computed again for each component
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def centroids(rows: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The unit mean of each cluster's unit vectors: whole vectors are summed before the shuffle, one a cluster and task."""
    mean = rows.where(F.col(key).isNotNull()).select(key, array_to_vector(unit(F.col("v"))).alias("_u")).groupBy(key).agg(Summarizer.mean(F.col("_u")).alias("_m"))
    return mean.select(key, unit(vector_to_array("_m")).alias("centroid"))


def medoids(rows: DataFrame, centroid: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The member nearest to its cluster's centroid; ties to the smaller id."""
    near = rows.join(centroid, key).select(key, "event_id", F.round(dot(unit(F.col("v")), F.col("centroid")), 9).alias("similarity"))
    return near.groupBy(key).agg(F.max_by("event_id", F.struct("similarity", -F.col("event_id"))).alias("event_id"), F.max("similarity").alias("similarity"))


def _packed(rows: DataFrame, key: str, at: bool, block: int, parts: int) -> DataFrame:
    """rows (key, v, with `at` also at) as a stored table of blocks, a row each: number, ids, unit vectors and instants as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting, n = [*waiting, batch], n + batch.num_rows
            while n >= block or (batch is None and n):
                every = pa.Table.from_batches(waiting).combine_chunks()
                here, rest = every.slice(0, block), every.slice(block)
                waiting, n = rest.to_batches(), rest.num_rows
                v = here["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(here.num_rows, -1).astype(float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                numbers = lambda c, t=here: t[c].to_numpy().astype(np.int64).tobytes()
                yield pa.RecordBatch.from_pylist([{"name": uuid.uuid4().hex, "ids": numbers(key), "v": v.tobytes(), "at": numbers("at") if at else b""}], schema)

    schema = pa.schema([("name", pa.string()), ("ids", pa.binary()), ("v", pa.binary()), ("at", pa.binary())])
    return stored(rows.coalesce(parts).mapInArrow(run, "name string, ids binary, v binary, at binary"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, digits: int = 9, before: int | None = None, floor: float | None = None) -> DataFrame:
    """query_id, place, id, similarity: each query's k rows of highest cosine, other ids only; ties to smaller ids.

    Queries (query_id, v) and rows (id, v) are written once, packed into blocks of bounded size, and every pair of blocks
    is one row of a cross join, which reads both tables and shuffles neither. A task multiplies one block of each and goes
    on with the k best; only those are shuffled, and merged by window. With `before`, both have `at` (seconds), and a
    query's rows are those of the so many seconds before it. With `floor`, less similar rows are left out.
    """
    at, cores = ["at"] if before else [], queries.sparkSession.sparkContext.defaultParallelism
    # small tables in smaller blocks, so that all cores have some
    sides = []
    for side, key in ((queries, "query_id"), (rows, "id")):
        n = side.count()
        size = min(block, max(256, -(-n // cores)))
        sides.append(_packed(side.select(key, *at, "v"), key, bool(before), size, max(1, min(cores, -(-n // size)))))
    left, right = sides
    pairs = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns]).crossJoin(right)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                pair = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                q, ids = np.frombuffer(pair["a_ids"], np.int64), np.frombuffer(pair["ids"], np.int64)
                x, y = np.frombuffer(pair["a_v"]).reshape(len(q), -1), np.frombuffer(pair["v"]).reshape(len(ids), -1)
                here = [close(q[j : j + FEW], x[j : j + FEW], ids, y, *([np.frombuffer(pair["a_at"], np.int64)[j : j + FEW], np.frombuffer(pair["at"], np.int64)] if before else [])) for j in range(0, len(q), FEW)]
                here = tuple(map(np.concatenate, zip(*here, strict=True)))
                if found is not None and pair["a_name"] == name:
                    here = tuple(map(np.concatenate, zip(found, here, strict=True)))
                elif found is not None:
                    yield out(found)
                name, found = pair["a_name"], first(here)
        if found is not None:
            yield out(found)

    def close(q: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, asked: np.ndarray | None = None, made: np.ndarray | None = None) -> tuple:
        s = x @ y.T
        s[:, ~np.isfinite(y).all(axis=1)] = -np.inf
        own = np.flatnonzero(np.isin(q, ids))
        s[own] = np.where(q[own, None] == ids[None, :], -np.inf, s[own])
        if before:
            ago = asked[:, None] - made[None, :]
            s = np.where((ago > 0) & (ago <= before), s, -np.inf)
        # rows that may round to the kth score or more, ties and all; only these are rounded and put in order
        kth = (s.max(axis=1) if k == 1 else np.partition(s, -k, axis=1)[:, -k]) if k < s.shape[1] else np.full(len(s), -np.inf)
        least = kth if floor is None else np.maximum(kth, floor)
        at, which = np.nonzero(s >= least[:, None] - 10.0**-digits)
        score = s[at, which]
        keep = np.isfinite(score)
        score = np.round(score[keep], digits)
        here = q[at[keep]], ids[which[keep]], score
        return here if floor is None else tuple(c[score >= floor] for c in here)

    def first(found: tuple) -> tuple:
        order = np.lexsort((found[1], -found[2], found[0]))
        q = found[0][order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        return tuple(c[order[place < k]] for c in found)

    def out(found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "id", "similarity"])

    found = pairs.mapInArrow(best, "query_id long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    result = stored(found.withColumn("place", place).where(F.col("place") <= k))
    discard(left, right)
    return result


def novelty(similar: DataFrame) -> DataFrame:
    """1 - the nearest centroid's similarity, within [0, 1]."""
    return similar.where("place = 1").select("query_id", (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))).alias("novelty"))


def density_clusters(rows: DataFrame, near: DataFrame, least: int, weight: float, reach: float) -> DataFrame:
    """event_id, root and n of the events in dense groups of at least `least`; the others are noise.

    rows has event_id and created_at; near (a, b, similarity) holds all pairs that may be within `reach`. A distance is
    1 - cosine plus `weight` a day; an event's core distance is that of its least - 1st neighbour; two events are linked
    if both core distances and their own are within `reach`; clusters are the connected components.
    """
    day = rows.select("event_id", (F.unix_micros("created_at") / 86_400_000_000).alias("day"))
    d = near.join(day.withColumnsRenamed({"event_id": "a", "day": "x"}), "a").join(day.withColumnsRenamed({"event_id": "b", "day": "y"}), "b")
    d = d.select("a", "b", (1 - F.col("similarity") + weight * F.abs(F.col("x") - F.col("y"))).alias("d")).where(F.col("d") <= reach)
    # a core distance is within reach exactly if enough neighbours are
    core = d.select(F.explode(F.array("a", "b")).alias("event_id")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least - 1).select("event_id")
    linked = d.join(core.withColumnRenamed("event_id", "a"), "a", "left_semi").join(core.withColumnRenamed("event_id", "b"), "b", "left_semi")
    found = components(linked.select("a", "b"))
    size = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(size, "root").select(F.col("node").alias("event_id"), "root", "n")
