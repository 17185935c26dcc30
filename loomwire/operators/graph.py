"""Connected components over edges, as repeated joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.storage import discard, stored

#: Tables of at most so many rows of two node names are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def spread(rows: DataFrame) -> DataFrame:
    """A stored table of few rows as a side of a broadcast join; a larger one as it is. The count is checked first."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (its component's least node) of all nodes of edges (a, b), by alternating large and small stars.

    Each round is written once and replaces the one before; a hub's edges are reduced by partial aggregation, and the
    joins read from files, so that adaptive execution can split a hub; few edges are joined by broadcast. Edges that
    already are stars around their least node take one round. The caller may discard the result once it is stored
    elsewhere.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())

    def pairs(*ways: tuple[str, str], names: tuple[str, str]) -> Column:
        return F.inline(F.array(*[F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in ways]))

    edges = stored(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")))
    seen = mark(edges)
    for _ in range(rounds):
        side = F.broadcast if seen[0] <= BROADCAST_ROWS else lambda df: df
        least = edges.select(pairs(("low", "high"), ("high", "low"), names=("u", "v"))).groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = edges.withColumnRenamed("low", "u").join(side(least), "u").select(F.col("m").alias("low"), "high").where(F.col("low") != F.col("high"))
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(side(least), "high").select(pairs(("m", "high"), ("m", "low"), names=("low", "high")))
        done, edges = edges, stored(small.where(F.col("low") != F.col("high")).distinct())
        discard(done)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    out = stored(edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()))
    discard(edges)
    return out


def extended(known: DataFrame, more: DataFrame) -> DataFrame:
    """`components` of known's edges and more (a, b); known is a stored result of `components`, more is stored.

    Only the further edges are worked on, between the components that they join: known's rows are renamed once.
    """
    rows, root = spread(known), lambda c: F.coalesce(f"_{c}", c).alias(c)
    of = lambda c: rows.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    tops = components(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(root("a"), root("b")))
    few = spread(tops)
    new = few.select("node", "root").join(rows.select("node"), "node", "left_anti")
    moved = known.join(few.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = stored(moved.unionByName(new))
    discard(tops)
    return out
