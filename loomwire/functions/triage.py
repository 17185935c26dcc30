"""The triage formula as column expressions over the dimension columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.params import DEFAULTS, SCORED, Params


def total(params: Params = DEFAULTS) -> Column:
    """Mean of the scored dimensions, lifted by sensitivity, at most 10."""
    base = sum((F.coalesce(F.col(d), F.lit(0.0)) for d in SCORED), F.lit(0.0)) / len(SCORED)
    return F.round(F.least(F.lit(10.0), base * (1 + F.coalesce(F.col("sensitivity"), F.lit(0.0)) * params.sensitivity)), 2)


def verdict(total_: Column, params: Params = DEFAULTS) -> Column:
    high = (total_ >= params.priority_total) | (F.col("urgency") >= params.priority_urgency)
    fast = (F.col("impact") >= params.fasttrack_impact) & (F.col("reliability") >= params.fasttrack_reliability)
    return F.when(high, "PRIORITY").when(fast, "FAST_TRACK").when(total_ >= params.investigate_total, "INVESTIGATE").otherwise("PASS")


def scored(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """`events` with total and verdict."""
    return events.withColumn("total", total(params)).withColumn("verdict", verdict(F.col("total"), params))


def distribution(rows: DataFrame) -> DataFrame:
    """One row per verdict and one, ALL, for all: events, mean total, and how many sit at the ceiling."""
    out = rows.rollup("verdict").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("total"), 2).alias("mean_total"), F.count_if(F.col("total") >= 10).alias("at_ceiling"), F.grouping("verdict").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("verdict")).alias("verdict"), "events", "mean_total", "at_ceiling")
