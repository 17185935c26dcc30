"""Stable cluster ids over runs: one-to-one matching to the end, and the snapshot that takes the ids over."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.operators.vectors import nearest
from loomwire.params import DEFAULTS, Params
from loomwire.storage import discard, new_folder, stored


def _lists(new: DataFrame, old: DataFrame, asking: DataFrame, floor: float, k: int) -> DataFrame:
    """side, id, other, similarity and more for the asking ids (side, id): their k best on the other side.

    more is true where the list may have been cut, so that further partners are possible.
    """
    parts = []
    for side, mine, others in (("new", new, old), ("old", old, new)):
        queries = mine.join(asking.where(F.col("side") == side).select("id"), "id", "left_semi")
        # an id may occur on both sides, and a search leaves out rows of the query's own id
        near = nearest(queries.select((-1 - F.col("id")).alias("query_id"), "v"), others.select("id", "v"), k)
        parts.append(near.select(F.lit(side).alias("side"), (-1 - F.col("query_id")).alias("id"), F.col("id").alias("other"), "similarity", "place"))
    found = parts[0].unionByName(parts[1]).where(F.col("similarity") >= floor)
    return found.withColumn("more", F.count(F.lit(1)).over(Window.partitionBy("side", "id")) == k).drop("place")


def match(new: DataFrame, old: DataFrame, floor: float, k: int = 5) -> DataFrame:
    """new_id, old_id and similarity: what a greedy pass from the best pair down gives, to the last pair above the floor.

    new and old have id (>= 0) and v. Both sides keep a list of their k best partners. Of each list the first partner
    that is still free is truly the best free one, so two rows that are each other's first are exactly those that the
    greedy pass would take next among their pairs; a round takes all of these at once. Rows whose list is used up and was
    cut ask again among the free rows, until no pair is left. Ties go to the smaller new id, then the smaller old id.
    Rows are taken in rounds; every round is stored and the one before is removed.
    """
    spark = new.sparkSession
    new, old = stored(new.select(F.col("id").cast("long"), "v")), stored(old.select(F.col("id").cast("long"), "v"))
    taken_at = new_folder(spark)
    schema = "new_id long, old_id long, similarity double"
    spark.createDataFrame([], schema).write.parquet(taken_at)
    everyone = new.select(F.lit("new").alias("side"), "id").unionByName(old.select(F.lit("old").alias("side"), "id"))
    lists = stored(_lists(new, old, everyone, floor, k))
    while not lists.isEmpty():
        first = Window.partitionBy("side", "id").orderBy(F.desc("similarity"), "other")
        heads = lists.withColumn("_r", F.row_number().over(first)).where("_r = 1")
        a, b = heads.where("side = 'new'"), heads.where("side = 'old'")
        mutual = a.select(F.col("id").alias("new_id"), F.col("other").alias("old_id"), "similarity").join(b.select(F.col("other").alias("new_id"), F.col("id").alias("old_id")), ["new_id", "old_id"])
        now = stored(mutual.select("new_id", "old_id", "similarity"))
        now.write.mode("append").parquet(taken_at)
        gone = now.select(F.lit("new").alias("side"), F.col("new_id").alias("id")).unionByName(now.select(F.lit("old").alias("side"), F.col("old_id").alias("id")))
        other_gone = gone.select(F.when(F.col("side") == "new", "old").otherwise("new").alias("side"), F.col("id").alias("other"))
        left = lists.join(gone, ["side", "id"], "left_anti")
        kept = stored(left.join(other_gone, ["side", "other"], "left_anti").select(*lists.columns))
        # lists that were cut and are used up now
        dry = stored(left.where("more").select("side", "id").distinct().join(kept.select("side", "id").distinct(), ["side", "id"], "left_anti"))
        if not dry.isEmpty():
            taken = spark.read.schema(schema).parquet(taken_at)
            free_new, free_old = new.join(taken.select(F.col("new_id").alias("id")), "id", "left_anti"), old.join(taken.select(F.col("old_id").alias("id")), "id", "left_anti")
            more = stored(kept.unionByName(_lists(free_new, free_old, dry, floor, k)))
            discard(kept)
            kept = more
        discard(lists, now, dry)
        lists = kept
    discard(lists, new, old)
    return spark.read.schema(schema).parquet(taken_at)


def fresh_id(least: Column, run: str) -> Column:
    """The id of a cluster that no earlier one gave its id to: the same whenever the run is repeated."""
    return F.pmod(F.xxhash64(F.lit(run), least), F.lit((1 << 62) - 1)) + 1


def persisted(clusters: DataFrame, events: DataFrame, members: DataFrame, matches: DataFrame, as_of: datetime, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The cluster and event tables after a run: both whole, as new versions of the old ones.

    clusters has cluster_id, label, first_seen, last_seen, event_count and status; events event_id, cluster_id,
    created_at and occurred_at. members is the run: event_id, the run's own label (null: noise) and title, the
    label's text. matches has new_id (a label) and old_id.

    A matched label keeps its old id, history and all; another gets a fresh one. Events of the run follow it, noise loses
    its cluster, and events that the run didn't see stay. A cluster that isn't in the run is dissolved if no event is left
    to it, and dormant if nothing was seen of it for long; labels of the run are active whatever their age.
    """
    inside = members.where(F.col("label").isNotNull()).join(events.select("event_id", "created_at", "occurred_at"), "event_id")
    run = inside.groupBy("label").agg(
        F.min("event_id").alias("_least"), F.min("created_at").alias("_first"), F.max("occurred_at").alias("_last"), F.count(F.lit(1)).alias("_n"), F.min_by("title", "event_id").alias("_title")
    )
    run = run.join(matches.select(F.col("new_id").alias("label"), "old_id"), "label", "left")
    run = stored(run.withColumn("cluster_id", F.coalesce("old_id", fresh_id(F.col("_least"), as_of.isoformat()))).withColumnRenamed("label", "_label"))
    moved = members.join(run.select("_label", F.col("cluster_id").alias("_to")), members["label"] == F.col("_label"), "left").select("event_id", "_to", F.lit(True).alias("_seen"))
    after = events.join(moved, "event_id", "left").withColumn("cluster_id", F.when(F.col("_seen"), F.col("_to")).otherwise(F.col("cluster_id"))).select(*events.columns)
    after = stored(after)
    held = after.where(F.col("cluster_id").isNotNull()).select("cluster_id").distinct().withColumn("_held", F.lit(True))
    both = clusters.join(run.drop("_label", "old_id", "_least"), "cluster_id", "full_outer").join(held, "cluster_id", "left")
    live = F.col("_n").isNotNull()
    stale = F.unix_timestamp("last_seen") < int(as_of.timestamp()) - params.dormant_days * 86400
    empty = (F.col("status") == "active") & F.col("_held").isNull()
    out = both.select(
        "cluster_id", F.when(live, F.col("_title")).otherwise(F.col("label")).alias("label"),
        F.when(live, F.least("first_seen", "_first")).otherwise(F.col("first_seen")).alias("first_seen"), F.when(live, F.greatest("last_seen", "_last")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(live, F.col("_n")).when(empty, F.lit(0).cast("long")).otherwise(F.col("event_count")).alias("event_count"),
        F.when(live, "active").when((F.col("status") == "active") & (empty | stale), "dormant").otherwise(F.col("status")).alias("status"),
    )
    return stored(out), after
