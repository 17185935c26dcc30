"""Vectors alike and near in time: a similarity join that skips what can't match, exactly.

Rows fall into blocks by time slot, nearest pivot and the ring around it that their distance falls into. Two rows that are near in time are in the same slot or in
neighbouring ones. A block knows the range of its rows' distances to every pivot; by the triangle inequality two blocks
whose ranges to one pivot are further apart than the floor allows have no pair, and are never sent to each other. What is
left is multiplied block by block, of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.operators.vectors import unit
from loomwire.storage import discard, stored

PIVOTS, RINGS, BLOCK = 16, 32, 2048


def _reach(floor: float) -> float:
    """The distance of two unit vectors whose cosine is the floor, with a margin for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * (floor - 1e-9))) + 1e-6


def blocks(rows: DataFrame, floor: float, seconds: int | None, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows (id, at, u, their block) and the blocks with their ranges, both stored. Rings are as wide as the floor reaches."""
    near = rows.select("id", F.col("at").cast("long").alias("at"), unit(F.col("v")).alias("u"))
    # the pivots are few rows, the same on every run
    chosen = np.array([list(r["u"]) for r in near.select("id", "u").orderBy(F.xxhash64("id"), "id").limit(pivots).collect()], float)

    width = _reach(floor)

    def tagged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            u = np.stack(part["u"].to_numpy())
            d = np.sqrt(np.maximum(0.0, (u * u).sum(1)[:, None] + (chosen * chosen).sum(1)[None, :] - 2 * u @ chosen.T))
            ring = np.minimum(d.min(1) / width, RINGS - 1).astype("int32")
            yield part.assign(p=d.argmin(1).astype("int32") * RINGS + ring, d=list(d))

    slot = F.floor(F.col("at") / seconds) if seconds else F.lit(0).cast("long")
    full = near.withColumn("slot", slot)
    if not len(chosen):
        full = full.withColumns({"p": F.lit(0), "d": F.array().cast("array<double>")})
    else:
        full = full.mapInPandas(tagged, "id long, at long, u array<double>, slot long, p int, d array<double>")
    full = stored(full)
    parts = full.groupBy("slot", "p").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")).withColumnsRenamed({"slot": "_slot", "p": "_p"})
    out = full.join(parts, (F.col("slot") == F.col("_slot")) & (F.col("p") == F.col("_p")))
    out = stored(out.select("id", "at", "u", "slot", "p", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("s"), "d"))
    discard(full)
    place = [F.get("d", F.lit(i)) for i in range(len(chosen))]
    ranges = [F.array(*[F.min(x) for x in place]).alias("low"), F.array(*[F.max(x) for x in place]).alias("high")]
    return out, stored(out.groupBy("slot", "p", "s").agg(*ranges))


def _apart(a: str, b: str) -> Column:
    """The least distance that two blocks' ranges allow."""
    gaps = F.zip_with(F.col(f"{a}.low"), F.col(f"{b}.high"), lambda x, y: x - y)
    other = F.zip_with(F.col(f"{b}.low"), F.col(f"{a}.high"), lambda x, y: x - y)
    return F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)), F.coalesce(F.array_max(other), F.lit(0.0)))


def pairs_of_blocks(found: DataFrame, floor: float) -> DataFrame:
    """Blocks that may have pairs (a and b, each once), and those that are skipped, as `kept`."""
    key = F.struct("slot", "p", "s")
    a = found.select(key.alias("ka"), "low", "high", F.explode(F.array("slot", F.col("slot") + 1)).alias("at")).alias("a")
    b = found.select(key.alias("kb"), "low", "high", F.col("slot").alias("at")).alias("b")
    both = a.join(b, F.col("a.at") == F.col("b.at")).where((F.col("ka.slot") < F.col("kb.slot")) | (F.col("ka") <= F.col("kb")))
    return both.select(F.col("ka").alias("a"), F.col("kb").alias("b"), (_apart("a", "b") <= _reach(floor)).alias("kept"))


def alike(rows: DataFrame, floor: float, seconds: int | None = None, digits: int = 9, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """a, b (a < b) and similarity of all pairs of rows (id, v, and at in seconds) whose cosine is `floor` (> 0) or more,
    not more than `seconds` apart. The result is stored.
    """
    tagged, found = blocks(rows if seconds else rows.withColumn("at", F.lit(0)), floor, seconds, pivots, block)
    pairs = stored(pairs_of_blocks(found, floor).where("kept").select("a", "b", F.xxhash64("a", "b").alias("pair")))
    key = lambda side: (F.col("slot") == F.col(f"{side}.slot")) & (F.col("p") == F.col(f"{side}.p")) & (F.col("s") == F.col(f"{side}.s"))
    left = tagged.join(pairs, key("a")).select("pair", (F.col("a") == F.col("b")).alias("same"), "id", "at", "u")
    right = tagged.join(pairs, key("b")).select(F.col("pair").alias("to"), F.col("id").alias("id_"), F.col("at").alias("at_"), F.col("u").alias("u_"))

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": "int64", "b": "int64", "similarity": "float64"})
        s = np.round(np.stack(x["u"].to_numpy()) @ np.stack(y["u_"].to_numpy()).T, digits)
        i, j = x["id"].to_numpy(), y["id_"].to_numpy()
        good = s >= floor
        if seconds:
            good &= np.abs(x["at"].to_numpy()[:, None] - y["at_"].to_numpy()[None, :]) <= seconds
        good &= (i[:, None] < j[None, :]) if x["same"].iloc[0] else (i[:, None] != j[None, :])
        m, n = np.nonzero(good)
        return pd.DataFrame({"a": np.minimum(i[m], j[n]), "b": np.maximum(i[m], j[n]), "similarity": s[m, n]})

    out = stored(left.groupBy("pair").cogroup(right.groupBy("to")).applyInPandas(met, "a long, b long, similarity double"))
    discard(tagged, found, pairs)
    return out


def best_before(queries: DataFrame, rows: DataFrame, seconds: int, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """id, match_id and similarity: each query's most alike row of the `seconds` before it, however unlike; ties to the smaller id.

    Both have id, v and at (seconds). Without a floor no block can be skipped for its vectors, only for its time: a
    query meets the rows of its own slot and of the one before, in blocks of bounded size. The result is stored.
    """

    def dealt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        df = df.select("id", F.col("at").cast("long").alias("at"), unit(F.col("v")).alias("u")).withColumn("slot", F.floor(F.col("at") / seconds))
        size = stored(df.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")))
        return df.join(size, "slot").select("id", "at", "u", "slot", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("s")), size

    def to(df: DataFrame, step: int, size: DataFrame) -> DataFrame:
        """The rows, once for each block of the other side that they meet."""
        other = size.select(F.col("slot").alias("_slot"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_s"))
        return df.withColumn("_at", F.explode(F.array("slot", F.col("slot") + step))).join(other, F.col("_at") == F.col("_slot"))

    left, asked = dealt(queries)
    right, held = dealt(rows)
    left = to(left, -1, held).select("id", "at", "u", F.col("slot").alias("a"), F.col("s").alias("p"), F.col("_slot").alias("b"), F.col("_s").alias("q"))
    right = to(right, 1, asked).select(F.col("id").alias("id_"), F.col("at").alias("at_"), F.col("u").alias("u_"), F.col("_slot").alias("a_"), F.col("_s").alias("p_"), F.col("slot").alias("b_"), F.col("s").alias("q_"))

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "match_id": [], "similarity": []}).astype({"id": "int64", "match_id": "int64", "similarity": "float64"})
        y = y.sort_values("id_")
        ago = x["at"].to_numpy()[:, None] - y["at_"].to_numpy()[None, :]
        s = np.where((ago > 0) & (ago <= seconds), np.round(np.stack(x["u"].to_numpy()) @ np.stack(y["u_"].to_numpy()).T, digits), -np.inf)
        most = s.argmax(1)
        s = s[np.arange(len(s)), most]
        return pd.DataFrame({"id": x["id"].to_numpy(), "match_id": y["id_"].to_numpy()[most], "similarity": s})[np.isfinite(s)]

    found = left.groupBy("a", "p", "b", "q").cogroup(right.groupBy("a_", "p_", "b_", "q_")).applyInPandas(met, "id long, match_id long, similarity double")
    best = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("m"))).alias("best"))
    out = stored(best.select("id", (-F.col("best.m")).alias("match_id"), F.col("best.similarity").alias("similarity")))
    discard(asked, held)
    return out
