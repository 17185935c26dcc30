"""Entity resolution: a grouping answer applied to the names that were asked about, with rules where there is none.

An answer says which of a group's names are one thing. It may be missing, broken, leave names out, name one twice or
invent some; whatever it says, each name ends up in exactly one resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.functions import names
from loomwire.functions.text import json_reply

#: What an entity may be.
TYPES = ["person", "org", "place", "team", "generic", "unknown"]
#: A member's number as the answer writes it; one written as a string counts as well.
ANSWER = "groups array<struct<members: array<string>, canonical: string, type: string, confidence: double>>"
#: Below this a resolution waits for a person; what rules alone say is below it, and what was left out is at the bottom.
SURE, BY_RULES, DROPPED = 0.75, 0.5, 0.0


def resolutions(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """group_id, part, canonical, type, mentions, confidence, aliases, decided_by, risk and needs_review.

    groups has group_id and members (in the order in which they were asked about), answers group_id and reply. Of names
    that several groups of an answer claim, the first group has them; numbers beyond the members are ignored, and a group
    that is left without a name is none. Names that no group has are one resolution at the lowest confidence, with
    `names_dropped` as its risk. Without an answer that can be read, the group is what the rules made it.
    """
    asked = groups.select("group_id", F.array_distinct("members").alias("members")).join(answers.select("group_id", "reply"), "group_id", "left")
    asked = asked.withColumn("a", F.from_json(json_reply(F.col("reply")), ANSWER)).withColumn("read", F.coalesce(F.col("a").isNotNull(), F.lit(False)))
    names_of = asked.select("group_id", "read", F.posexplode("members").alias("i", "member"))
    claims = asked.select("group_id", F.posexplode("a.groups").alias("g", "x")).select("group_id", "g", F.explode("x.members").alias("i")).where(F.col("i").rlike("^[0-9]{1,9}$")).select("group_id", "g", F.col("i").cast("int").alias("i"))
    first = claims.groupBy("group_id", "i").agg(F.min("g").alias("g"))
    rows = names_of.join(first, ["group_id", "i"], "left").withColumn("part", F.when(~F.col("read"), F.lit(-2)).otherwise(F.coalesce("g", F.lit(-1))))
    keys = rows.withColumn("_c", names.composed("member")).withColumn("p", names.parsed(F.col("_c")))
    # a group holds the names of one article, so what is collected is little
    by = keys.groupBy("group_id", "part").agg(
        F.array_sort(F.collect_set("member")).alias("mentions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("p.head"), "p.strong"))))).alias("aliases"), F.collect_set("p.head").alias("_heads")
    )
    said = asked.select("group_id", F.posexplode("a.groups").alias("part", "x")).select("group_id", "part", "x.canonical", "x.type", "x.confidence")
    out = by.join(said, ["group_id", "part"], "left")
    llm = F.col("part") >= 0
    kind = F.when(llm & F.col("type").isin(TYPES), F.col("type")).otherwise("unknown")
    confidence = F.when(llm, F.coalesce("confidence", F.lit(BY_RULES))).when(F.col("part") == -1, DROPPED).otherwise(BY_RULES)
    risk = F.when(F.col("part") == -1, "names_dropped").when(names.risky(F.col("_heads")), "joined_on_bracket")
    # a proposed name only counts beside the ones that the article has
    named = names.display_name(F.when(llm & F.col("canonical").isNotNull(), F.concat("mentions", F.array("canonical"))).otherwise(F.col("mentions")))
    return out.select(
        "group_id", "part", named.alias("canonical"), kind.alias("type"), "mentions", confidence.alias("confidence"), "aliases", F.when(llm, "llm").otherwise("rules").alias("decided_by"), risk.alias("risk"),
        ((confidence < SURE) | risk.isNotNull()).alias("needs_review"),
    )


def works(label: Column, description: Column, markers: list[str]) -> Column:
    """Whether a candidate is a song, film or the like, by the words (lower case) that markers lists."""
    text = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(description, F.lit(""))))
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def plausible(candidates: DataFrame, markers: list[str]) -> DataFrame:
    """Candidates (label, description, entity_type) that can be meant: a work only for an entity of unknown type."""
    return candidates.where(~works(F.col("label"), F.col("description"), markers) | (F.coalesce("entity_type", F.lit("unknown")) == "unknown"))


def backfill(entities: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """The next entities to ask about, most mentioned first: those without a decision, that no earlier pass has done."""
    open_ = entities.where(F.coalesce("qid_status", F.lit("pending")) == "pending").join(done.select("entity_id"), "entity_id", "left_anti")
    first = Window.partitionBy("name").orderBy(F.desc("mention_count"), "entity_id")
    one = open_.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return one.orderBy(F.desc("mention_count"), "entity_id").limit(most)
