"""Signals in, decisions and dispatches out; every answer of a model is a column that may be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.operators.views import per_key

UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
SIGNAL_TYPES = ["weak_signal", "trend_breakout", "beat_match"]
WATCH_TYPES = ["keyword", "source", "entity", "other"]
SIGNAL = "signal_type string, ref_id string, cluster_id string, event_id string, title string, combined_score double, trend_score double"


def parsed_signals(messages: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Messages (value, further columns) as signals: junk, unknown types and bad references are dropped, a bad cluster or
    event id is null."""
    rows = messages.withColumn("_s", F.from_json("value", SIGNAL, {"mode": "PERMISSIVE"}))
    keep = F.col("_s.signal_type").isin(types or SIGNAL_TYPES) & F.col("_s.ref_id").rlike(UUID)
    ident = lambda c: F.when(F.col(f"_s.{c}").rlike(UUID), F.col(f"_s.{c}"))
    return rows.where(keep).select(
        *messages.columns, "_s.signal_type", "_s.ref_id", ident("cluster_id").alias("cluster_id"), ident("event_id").alias("event_ref"),
        F.coalesce("_s.title", F.lit("")).alias("title"), F.coalesce("_s.combined_score", F.lit(0.0)).alias("combined_score"), F.coalesce("_s.trend_score", F.lit(0.0)).alias("trend_score"),
    )


def indicators(raw: Column, most: int = 5, default: str = "other") -> Column:
    """Indicators with a description, unknown watch types made the default, the first `most`."""
    clean = F.transform(raw, lambda x: F.struct(F.trim(x["description"]).alias("description"), F.when(F.trim(x["watch_type"]).isin(WATCH_TYPES), F.trim(x["watch_type"])).otherwise(default).alias("watch_type")))
    return F.slice(F.filter(F.coalesce(clean, F.array()), lambda x: x["description"] != ""), 1, most)


def uncertainty(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("low", 0.2, "medium", 0.5, "high", 0.8)]), F.lower(F.trim(label))), F.lit(0.5))


def link_decisions(asked: DataFrame, sure: float = 0.75) -> DataFrame:
    """The decision on each question (n candidates, match, mirror, confidence, hedged; null answers are failures).

    A match outside the list is none. The mirrored question agrees if it says the same; a link is certain if it
    agreed, wasn't hedged and is confident enough.
    """
    match = F.when(F.col("match").between(0, F.col("n") - 1), F.col("match"))
    agreed = F.coalesce((F.col("mirror") == 0) == match.isNotNull(), F.lit(False))
    out = asked.withColumns({"choice": match, "agreed": (F.col("n") == 0) | agreed, "failed": (F.col("n") > 0) & F.col("confidence").isNull()})
    certain = ~F.col("failed") & F.col("agreed") & ~F.coalesce("hedged", F.lit(False)) & (F.coalesce("confidence", F.when(F.col("n") == 0, 1.0)) >= sure)
    return out.withColumn("certain", F.coalesce(certain, F.lit(False)))


def review(decisions: DataFrame) -> DataFrame:
    why = F.concat_ws("; ", F.when(F.col("failed"), "undecided"), F.when(~F.col("agreed"), "contradicted"), F.when(F.col("hedged"), "hedged"))
    return decisions.withColumn("review_status", F.when(F.col("certain"), "auto").otherwise("needs_review")).withColumn("risk", F.when(~F.col("certain"), why))


def scenario_context(events: DataFrame, scored: DataFrame, summaries: int = 50, windows: int = 10) -> DataFrame:
    """Each cluster's newest stories and last windows, oldest first; clusters with one story have no scenario."""
    news = per_key(events.where("cluster_id IS NOT NULL"), "cluster_id", [F.desc("created_at"), F.desc("event_id")], summaries)
    news = news.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id"))), lambda x: x["event_id"]).alias("stories")).where(F.size("stories") >= 2)
    last = per_key(scored, "cluster_id", [F.desc("slot")], windows)
    last = last.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "trend_score"))), lambda x: x["trend_score"]).alias("trend"))
    return news.join(last, "cluster_id", "left")


def payloads(signals: DataFrame, top: DataFrame) -> DataFrame:
    """The dispatch payload's scalar part: rounded scores, and the title or else the top story's summary."""
    s = signals.join(top, "cluster_id", "left")
    return s.select("signal_id", "cluster_id", F.coalesce(F.nullif("title", F.lit("")), "summary", F.lit("")).alias("title"), F.round("combined_score", 4).alias("combined_score"), F.round("trend_score", 4).alias("trend_score"))


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the patch's non-null values."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in patch.columns if c != key])
    return rows.join(p, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in patch.columns and c != key else F.col(c) for c in rows.columns])


def split_mentions(mentions: DataFrame, moved: DataFrame) -> DataFrame:
    """Mentions (entity_id, surface, event_id) after the surfaces of `moved` (entity_id, surface, new_id) left; a move of
    none or of all of an entity's surfaces is refused."""
    rows = mentions.join(moved, ["entity_id", "surface"], "left")
    share = rows.groupBy("entity_id").agg(F.count("new_id").alias("_m"), F.count(F.lit(1)).alias("_n"))
    legal = (F.col("_m") > 0) & (F.col("_m") < F.col("_n"))
    return rows.join(share, "entity_id").select(F.when(legal, F.coalesce("new_id", "entity_id")).otherwise(F.col("entity_id")).alias("entity_id"), "surface", "event_id")
