"""Read views: feeds, timelines, tallies and exports. Small sides are left to the optimizer and adaptive execution."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.params import DEFAULTS, Params


def gate(articles: DataFrame, sources: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Articles with their source's credibility (a default where unknown) and whether they pass; the bound passes."""
    w = F.coalesce(F.col("credibility"), F.lit(params.default_credibility))
    return articles.join(sources.withColumnRenamed("name", "source"), "source", "left").withColumn("credibility", w).withColumn("passes", F.col("credibility") >= params.gate_threshold)


def statuses(gated: DataFrame) -> DataFrame:
    """Each article's status: below the gate, an exact copy of an earlier body, or processed."""
    digest = F.md5("body")
    first = gated.where("body IS NOT NULL").groupBy(digest.alias("_b")).agg(F.min("doc_id").alias("_first"))
    # an article without a body is no copy; a left join keeps it without gathering such rows anywhere
    out = gated.withColumn("_d", digest).join(first, F.col("_d") == F.col("_b"), "left")
    status = F.when(~F.col("passes"), "dropped_lowcred").when(F.col("doc_id") != F.col("_first"), "duplicate").otherwise("processed")
    return out.select("doc_id", "source", "credibility", "fetched_at", status.alias("status"))


def tally(rows: DataFrame, key: str, at: str = "key") -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias(at)).agg(F.count(F.lit(1)).alias("n"))


def failure_rate(rows: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """failed, decided and rate (percent, 0 without decisions) of the last hours."""
    recent = rows.where(F.col("fetched_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    out = recent.agg(F.count_if(F.col("status") == "dropped_lowcred").alias("failed"), F.count(F.lit(1)).alias("decided"))
    return out.select("failed", "decided", F.when(F.col("decided") > 0, F.round(100 * F.col("failed") / F.col("decided"), 1)).otherwise(0.0).alias("rate"))


def verdict_tally(rows: DataFrame, column: str = "verdict") -> DataFrame:
    """A row per verdict, ALL over every row, and UNSCORED for those without one; one scan."""
    out = rows.rollup(column).agg(F.count(F.lit(1)).alias("n"), F.grouping(column).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "ALL").when(F.col(column).isNull(), "UNSCORED").otherwise(F.col(column)).alias("verdict"), "n")


def grouping_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone, as (facet, value, n), in one scan by exploding the facets before the aggregate."""
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def feed(events: DataFrame, order: str, limit: int = 200, offset: int = 0) -> DataFrame:
    """The newest events, or those of highest total (nulls last); ties by id."""
    by = [F.desc_nulls_last("total")] if order == "score" else []
    return events.orderBy(*by, F.desc("created_at"), F.desc("event_id")).offset(offset).limit(limit)


def per_key(rows: DataFrame, key: str, order: list[Column], most: int, place: str = "place") -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) <= most)


def top_categories(events: DataFrame, most: int = 3) -> DataFrame:
    counted = events.where("cluster_id IS NOT NULL AND category IS NOT NULL").groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return per_key(counted, "cluster_id", [F.desc("n"), F.col("category")], most)


def verdict_export(dispatches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Dispatches with their verdicts; `to_json_lines` makes the export's rows of it."""
    return dispatches.join(verdicts, "dispatch_id").select("dispatch_id", "ref_id", "signal_type", "verdict", "received_at")


def to_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key).distinct(), key, "left_anti")


def recently_reasoned(dispatches: DataFrame, as_of: datetime, hours: int = DEFAULTS.cooldown_hours) -> DataFrame:
    """ref_ids that have a dispatch in the cooldown."""
    since = F.timestamp_seconds(F.lit(int(as_of.timestamp()) - hours * 3600))
    return dispatches.where(F.col("created_at") >= since).select("ref_id").distinct()


def rivals(clusters: DataFrame, most: int = DEFAULTS.rivals) -> DataFrame:
    """cluster_id and its largest other clusters: the most + 1 largest of all, less itself; no pair of clusters is formed.

    The short list has most + 1 rows, which bounds its broadcast.
    """
    order = [F.desc("event_count"), F.desc("last_seen"), F.col("cluster_id")]
    top = clusters.orderBy(*order).limit(most + 1).select(F.collect_list(F.struct("event_count", "last_seen", "cluster_id")).alias("_t"))
    ranked = F.sort_array(F.transform("_t", lambda x: F.struct((-x["event_count"]).alias("a"), (-F.unix_micros(x["last_seen"])).alias("b"), x["cluster_id"].alias("c"))))
    short = top.select(ranked.alias("_r"))
    joined = clusters.select("cluster_id").join(F.broadcast(short))
    own = F.slice(F.filter("_r", lambda x: x["c"] != F.col("cluster_id")), 1, most)
    return joined.select("cluster_id", F.posexplode(own).alias("place", "r")).select("cluster_id", (F.col("place") + 1).alias("place"), F.col("r.c").alias("rival_id"))
