"""Entities and beats: mentions, candidates by shared alias, surfaces, shortlists and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.functions import names
from loomwire.operators.graph import components
from loomwire.params import DEFAULTS, Params


def cluster_entities(mentions: DataFrame, key: str) -> DataFrame:
    """Distinct events of each entity in each cluster."""
    return mentions.groupBy(key, "entity_id").agg(F.countDistinct("event_id").alias("events"))


def surfaces(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_id").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def alias_candidates(probes: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """Each probe's best entities that share an alias: by mentions, then id.

    An alias may be everyone's, so each keeps only its best most + 1 entities before the join: a probe's best ones are
    among those, and no alias can multiply rows.
    """
    rank = Window.partitionBy("alias").orderBy(F.desc("mention_count"), "entity_id")
    best = entities.select("entity_id", "mention_count", F.explode("aliases").alias("alias")).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= most + 1)
    met = probes.select("probe_id", F.explode("aliases").alias("alias")).join(best, "alias").where("probe_id <> entity_id").select("probe_id", "entity_id", "mention_count").distinct()
    place = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("mention_count"), "entity_id"))
    return met.withColumn("place", place).where(F.col("place") <= most)


def beat_matches(shortlist: DataFrame, events: DataFrame, seen: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Shortlisted events (beat, event_id, similarity, wanted categories) that pass the floor, the categories and the
    answers (yes), aren't matched already, at most beat_cap a beat, best first; `capped` where the cap was reached."""
    fits = F.col("wanted").isNull() | (F.size("wanted") == 0) | F.array_contains("wanted", F.col("category"))
    rows = shortlist.join(events, "event_id").where((F.col("total") >= params.beat_floor) & fits & F.col("yes")).join(seen, ["beat", "event_id"], "left_anti")
    w = Window.partitionBy("beat").orderBy(F.desc("similarity"), "event_id")
    all_of = Window.partitionBy("beat")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("capped", F.count(F.lit(1)).over(all_of) > params.beat_cap)
    return rows.where(F.col("place") <= params.beat_cap)


def mention_groups(mentions: DataFrame, qualifiers: bool = True) -> DataFrame:
    """event_id, raw, group (its first spelling), members, name and risky: spellings that share a head or a strong alias.

    A spelling joins the first holder of each of its keys unless their qualifiers differ (if they count); what hangs together within an
    event is one group.
    """
    one = mentions.select("event_id", "raw").distinct().withColumn("_composed", names.composed("raw")).withColumn("p", names.parsed(F.col("_composed"))).drop("_composed")
    keyed = one.select("event_id", "raw", (F.col("p.qualifiers") if qualifiers else F.lit(0)).alias("q"), F.explode(F.array_distinct(F.concat(F.array("p.head"), "p.strong"))).alias("key"))
    first = keyed.groupBy("event_id", "key").agg(F.min(F.struct("raw", "q")).alias("f"))
    node = lambda raw: F.concat_ws("\x1f", F.col("event_id").cast("string"), raw)
    edges = keyed.join(first, ["event_id", "key"]).where((F.col("raw") != F.col("f.raw")) & (F.col("q") == F.col("f.q"))).select(node(F.col("f.raw")).alias("a"), node(F.col("raw")).alias("b"))
    found = components(edges)
    rows = one.withColumn("node", node(F.col("raw"))).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = rows.groupBy("event_id", "root").agg(F.array_sort(F.collect_set("raw")).alias("members"), F.collect_set("p.head").alias("heads"))
    return by.select("event_id", F.get("members", F.lit(0)).alias("group"), "members", names.display_name(F.col("members")).alias("name"), names.risky(F.col("heads")).alias("risky"))
