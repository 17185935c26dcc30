"""The desk's reads and state changes: list views, projections, reviews, validation. Column rules and plain joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.functions.text import confidence, json_reply, list_of

#: Page sizes of lists are held within this bound.
MOST = 500
#: Confidence from which a decision needs no review.
SURE = 0.75


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, **equal: object) -> DataFrame:
    """One page of a list: optional equality filters (None: not asked), an order, and a clamped limit."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MOST)))


def newest_capped(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The newest `most` rows, each with how many there were; the report of a cut comes with the rows."""
    total = rows.agg(F.count(F.lit(1)).alias("available"))
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("available") > most)


def incomplete(actors: Column, action: Column) -> Column:
    return (F.coalesce(F.size(actors), F.lit(0)) <= 0) | action.isNull()


def null_safe(column: Column, unwanted: list[str]) -> Column:
    """True where the column is null or none of the unwanted values; SQL's NOT IN would lose the nulls."""
    return column.isNull() | ~column.isin(unwanted)


def gated(rows: DataFrame, strategy: Callable[[DataFrame], Column]) -> DataFrame:
    """Any rule from a row to a boolean column can be the gate; a null answer doesn't pass."""
    return rows.withColumn("passes", F.coalesce(strategy(rows), F.lit(False)))


def extracted(reply: Column, categories: list[str]) -> Column:
    """A model's reply as a typed row that never fails: lists cleaned, the summary cut, confidence within [0, 1]."""
    raw = F.from_json(json_reply(reply), "actors array<string>, action string, categories array<string>, summary string, confidence string", {"mode": "PERMISSIVE"})
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(
        list_of(raw["actors"]).alias("actors"), blank(raw["action"]).alias("action"), list_of(raw["categories"], categories, 3).alias("categories"), F.left(F.coalesce(F.trim(raw["summary"]), F.lit("")), F.lit(280)).alias("summary"),
        confidence(raw["confidence"]).alias("confidence"),
    )


def reviewed(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """entities after reviews (entity_id, decision): a confirmed one is certain, a rejected one is kept and marked."""
    out = entities.join(reviews, "entity_id", "left")
    status = F.when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "reject", "rejected").otherwise(F.col("review_status"))
    sure = F.when(F.col("decision") == "confirm", 1.0).otherwise(F.col("confidence"))
    return out.withColumn("review_status", status).withColumn("confidence", sure).withColumn("decided", F.col("decision").isNotNull()).drop("decision")


def persisted(stored: DataFrame, found: DataFrame) -> DataFrame:
    """stored entities widened by found ones (entity_id, aliases, type, at): counters, aliases, type and times; new ones added."""
    new = found.groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("_a"), F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("type") != "unknown", F.col("type"))).alias("_t"), F.max("at").alias("_at"))
    out = stored.join(new, "entity_id", "full")
    none = F.array().cast("array<string>")
    known = F.when(F.coalesce("type", F.lit("unknown")) != "unknown", F.col("type"))
    return out.select(
        "entity_id", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("_a", none))).alias("aliases"), (F.coalesce("mention_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("mention_count"),
        F.coalesce(known, F.col("_t"), F.lit("unknown")).alias("type"), F.greatest("last_seen", "_at").alias("last_seen"),
    )


def narrowed(aliases: Column, moved: Column, remaining: Column) -> Column:
    """The aliases of an entity after a split: those that moved go unless a remaining mention still uses them."""
    return F.array_except(aliases, F.array_except(moved, remaining))


def first_of_each(parts: list[DataFrame], keys: list[str], group: str, most: int) -> DataFrame:
    """An ordered merge without repeats: earlier parts and earlier places win. parts have group, keys and place."""
    from pyspark.sql.window import Window

    every = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_part", F.lit(i)))
    order = [F.col("_part"), F.col("place")]
    once = every.withColumn("_r", F.row_number().over(Window.partitionBy(group, *keys).orderBy(*order))).where("_r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order, *keys))).where(F.col("place") <= most).drop("_part", "_r")


def choice(offered: Column, chosen: Column, sure: Column, least: float = 0.8) -> Column:
    """linked, review or none: only a candidate that was offered counts, and a hesitant answer is reviewed."""
    return F.when(chosen.isNull(), "none").when(~F.array_contains(offered, chosen), "review").when(F.coalesce(sure, F.lit(0.0)) < least, "review").otherwise("linked")


def may_merge(qid_a: Column, qid_b: Column, type_a: Column, type_b: Column) -> Column:
    """Not of different ids, nor a person with an organisation, place or team."""
    person = lambda a, b: (a == "person") & b.isin("organisation", "place", "team")
    return ~(F.coalesce(qid_a != qid_b, F.lit(False)) | F.coalesce(person(type_a, type_b) | person(type_b, type_a), F.lit(False)))


def updated(stories: DataFrame, updates: DataFrame) -> DataFrame:
    """stories (event_id, summary) after updates (event_id, at, summary, report_id): the newest summary, and an audit list."""
    by = updates.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("at", "report_id", F.col("summary").alias("text")))).alias("event_updates"))
    out = stories.join(by, "event_id", "left")
    audit = F.coalesce("event_updates", F.array().cast(by.schema["event_updates"].dataType))
    return out.withColumn("event_updates", audit).withColumn("summary", F.coalesce(F.try_element_at("event_updates", F.lit(-1))["text"], F.col("summary")))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and broken: how many rows break each rule (a null answer is no breach), in one scan."""
    counts = rows.agg(*[F.count_if(~r).alias(n) for n, r in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("v")).select("v.*")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def life_cycle(sent: Column, answered: Column, attempts: Column, most: int = 4) -> Column:
    """A dispatch's status: closed by a verdict, sent, pending while attempts are left, else failed."""
    return F.when(answered.isNotNull(), "closed").when(sent, "delivered").when(attempts <= most, "pending").otherwise("failed")


def swept(outbox: DataFrame, announced: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The oldest signals of the outbox that were not announced yet."""
    return outbox.join(announced.select(key), key, "left_anti").orderBy("created_at", key).limit(most)


def isolated(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A column that may fail on a row, as null with the row's status; no row stops the others."""
    return rows.withColumn(name, value).withColumn("status", F.when(F.col(name).isNull(), "failed").otherwise("processed"))
