"""Pairwise-preference ranking: a small matrix per force, its principal vector, consistency and ranks, as array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.operators.vectors import dot
from loomwire.params import DEFAULTS, RANDOM_INDEX, Params

STEPS = 100


def matrices(alternatives: DataFrame, wins: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """force and m, the reciprocal matrix over its alternatives (force, pos); wins has force, i, j and i_wins.

    Alternatives are few by the model (at most 26 here, 6 by default): a force's matrix is one bounded row.
    """
    p = params.preference
    both = wins.where("i_wins IS NOT NULL").select("force", F.explode(F.array(
        F.struct(F.col("i").alias("r"), F.col("j").alias("c"), F.when(F.col("i_wins"), p).otherwise(1 / p).alias("x")),
        F.struct(F.col("j").alias("r"), F.col("i").alias("c"), F.when(F.col("i_wins"), 1 / p).otherwise(p).alias("x")),
    )).alias("e")).select("force", "e.*")
    cells = both.groupBy("force").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c"), "x"))).alias("_m"))
    size = alternatives.groupBy("force").agg(F.count(F.lit(1)).cast("int").alias("n"))
    at = lambda r, c: F.coalesce(F.try_element_at("_m", F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))), F.lit(1.0))
    grid = F.sequence(F.lit(0), F.col("n") - 1)
    return size.join(cells, "force", "left").select("force", "n", F.transform(grid, lambda r: F.transform(grid, lambda c: at(r, c))).alias("m"))


def priority(m: Column, n: Column) -> Column:
    """The principal vector by power iteration, summing to one."""
    start = F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(1.0) / n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def step(v: Column, _: Column) -> Column:
        nxt = F.transform(m, lambda row: dot(row, v))
        return F.transform(nxt, lambda x: x / total(nxt))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def consistency(m: Column, w: Column, n: Column) -> Column:
    """The consistency ratio; 0 below three alternatives and beyond the published table."""
    index = F.create_map(*[F.lit(x) for kv in RANDOM_INDEX.items() for x in kv])
    lam = F.aggregate(F.zip_with(m, w, lambda row, x: dot(row, w) / x), F.lit(0.0), lambda a, x: a + x) / n
    ri = F.try_element_at(index, n)
    return F.coalesce(F.when(n >= 3, F.greatest(F.lit(0.0), (lam - n) / (n - 1) / ri)), F.lit(0.0))


def impacts(matrix: DataFrame) -> DataFrame:
    """force, pos, weight, impact (against the strongest), rank (ties by position) and ratio."""
    solved = matrix.withColumn("w", priority(F.col("m"), F.col("n")))
    solved = solved.select("force", "w", consistency(F.col("m"), F.col("w"), F.col("n")).alias("ratio"))
    rows = solved.select("force", "ratio", F.array_max("w").alias("_top"), F.posexplode("w").alias("pos", "weight"))
    rank = F.row_number().over(Window.partitionBy("force").orderBy(F.desc(F.round("weight", 9)), "pos"))
    return rows.select("force", "pos", "weight", (F.col("weight") / F.col("_top")).alias("impact"), rank.alias("rank"), "ratio")


def pair_wins(alternatives: DataFrame) -> DataFrame:
    """All pairs i < j of a force's alternatives (force, pos, score) and which one leads; equal scores are unjudged."""
    a, b = alternatives.alias("a"), alternatives.alias("b")
    lead = F.when(F.col("a.score") != F.col("b.score"), F.col("a.score") > F.col("b.score"))
    return a.join(b, (F.col("a.force") == F.col("b.force")) & (F.col("a.pos") < F.col("b.pos"))).select(F.col("a.force").alias("force"), F.col("a.pos").cast("int").alias("i"), F.col("b.pos").cast("int").alias("j"), lead.alias("i_wins"))
