"""Repair of the entity store: names and aliases derived anew, and entities that are one folded together.

Entities are taken by priority, the most mentioned first. One whose aliases an earlier one holds is folded into it,
unless their ids or types speak against it; then it is flagged, as is one whose own spellings don't hang together, and
nothing may join those. Who holds an alias depends on all decisions before, so the pass is serial; but only among
entities that aliases connect. The store therefore falls into its connected components, which are decided side by side,
each by priority; a component of more than `CHUNK` entities is decided in as many rounds, of which each goes on with the
holders that the one before left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.functions import names
from loomwire.operators.entities import mention_groups
from loomwire.operators.graph import components
from loomwire.storage import discard, stored

#: Entities of one component that are decided in one task and round.
CHUNK = 20_000
DECIDED = ("confirmed", "rejected")


def derived(mentions: DataFrame) -> DataFrame:
    """entity_id, name, aliases and related of the entities that mentions (entity_id, surface) has spellings of.

    related is false where the spellings, by their heads and strong aliases alone, fall into several groups.
    """
    forms = mentions.select("entity_id", F.col("surface").alias("raw")).where("raw IS NOT NULL").distinct()
    keys = forms.withColumn("_c", names.composed("raw")).select("entity_id", names.parsed(F.col("_c")).alias("p")).select("entity_id", F.explode(F.concat(F.array("p.head"), "p.strong")).alias("k")).distinct()
    by = keys.groupBy("entity_id").agg(F.array_sort(F.collect_list("k")).alias("aliases"))
    name = forms.groupBy("entity_id").agg(names.display_name(F.array_sort(F.collect_list("raw"))).alias("name"))
    groups = mention_groups(forms.withColumnRenamed("entity_id", "event_id"), qualifiers=False).groupBy(F.col("event_id").alias("entity_id")).agg((F.count(F.lit(1)) == 1).alias("related"))
    return by.join(name, "entity_id").join(groups, "entity_id")


def refusal(qid: Column, other_qid: Column, kind: Column, other: Column) -> Column:
    """Why two entities must stay apart: different ids, or a person and something that is none; else null."""
    things = ["org", "place", "team"]
    mixed = ((kind == "person") & other.isin(things)) | ((other == "person") & kind.isin(things))
    return F.when(qid != other_qid, "different_items").when(mixed, "type_mismatch")


def _apart(qid: object, other_qid: object, kind: str, other: str) -> str | None:
    if qid and other_qid and qid != other_qid:
        return "different_items"
    return "type_mismatch" if "person" in (kind, other) and {kind, other} & {"org", "place", "team"} else None


_OUT = "kind string, entity_id long, into long, alias string, qid string, type string, outcome string"


def _serial(entities: pd.DataFrame, holders: pd.DataFrame) -> pd.DataFrame:
    """The decisions over one component's next entities, and the holders' aliases, ids and types that result."""
    held = dict(zip(holders["alias"], holders["holder"], strict=True))
    known = {h: [q, t] for h, q, t in zip(holders["holder"], holders["holder_qid"], holders["holder_type"], strict=True)}
    out = []
    for e in entities.sort_values("rank").itertuples():
        aliases, outcome, into = list(e.aliases), "kept", None
        if e.spelt and not e.related:
            outcome, aliases = "unrelated_names", []
        else:
            into = next((held[a] for a in aliases if a in held), None) if e.spelt else None
            if into is None:
                known[e.entity_id] = [e.qid, e.type]
            else:
                mine = known[into]
                outcome = _apart(mine[0], e.qid, mine[1], e.type) or "merged"
                if outcome == "merged":
                    mine[0], mine[1] = mine[0] or e.qid, e.type if mine[1] == "unknown" else mine[1]
                else:
                    aliases = []
        for a in aliases:
            if a not in held:
                held[a] = e.entity_id if into is None else into
                out.append(("alias", held[a], None, a, None, None, None))
        out.append(("entity", e.entity_id, into, None, None, None, outcome))
    out += [("holder", h, None, None, q, t, None) for h, (q, t) in known.items()]
    return pd.DataFrame(out, columns=["kind", "entity_id", "into", "alias", "qid", "type", "outcome"]).astype({"entity_id": "int64", "into": "Int64"}).replace({float("nan"): None})


def decided(entities: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """entity_id, outcome (kept, merged, unrelated_names, different_items, type_mismatch) and into.

    entities has entity_id, name, aliases (sorted), mention_count, type, qid, spelt (whether it has spellings) and
    related. Nothing is changed: this is the dry run.
    """
    rows = stored(entities.select("entity_id", "name", "aliases", "mention_count", "type", "qid", "spelt", "related"))
    # one alias, one star: its first holder stands for it
    aliased = rows.select("entity_id", F.explode("aliases").alias("alias"))
    hub = aliased.groupBy("alias").agg(F.min("entity_id").alias("a"))
    found = components(aliased.join(hub, "alias").select("a", F.col("entity_id").alias("b")))
    rank = Window.partitionBy("root").orderBy(F.desc("mention_count"), "name", "entity_id")
    left = rows.join(found.select(F.col("node").alias("entity_id"), "root"), "entity_id", "left").withColumn("root", F.coalesce("root", "entity_id"))
    left = stored(left.withColumn("rank", F.row_number().over(rank)))
    discard(rows, found)
    done, holders = [], None
    rounds = -(-(left.agg(F.max("rank")).first()[0] or 0) // chunk)
    for i in range(rounds):
        now = left.where((F.col("rank") > i * chunk) & (F.col("rank") <= (i + 1) * chunk))
        if holders is None:
            held = left.select("root", F.lit("").alias("alias"), F.col("entity_id").alias("holder"), F.col("qid").alias("holder_qid"), F.col("type").alias("holder_type")).limit(0)
        else:
            wanted = now.select("root", F.explode("aliases").alias("alias")).distinct()
            held = holders.join(wanted, ["root", "alias"], "left_semi")
        root = now.select("root", "rank", "entity_id", "aliases", "type", "qid", "spelt", "related")
        out = stored(root.groupBy("root").cogroup(held.groupBy("root")).applyInPandas(lambda key, e, h: _serial(e, h).assign(root=key[0]), _OUT + ", root long"))
        done.append(out)
        if i < rounds - 1:
            new = out.where("kind = 'alias'").select("root", "alias", F.col("entity_id").alias("holder"))
            state = out.where("kind = 'holder'").select(F.col("entity_id").alias("holder"), F.col("qid").alias("_q"), F.col("type").alias("_t"))
            every = new if holders is None else new.unionByName(holders.select("root", "alias", "holder"))
            before = holders.select("holder", "holder_qid", "holder_type").distinct() if holders is not None else state.limit(0).select("holder", F.col("_q").alias("holder_qid"), F.col("_t").alias("holder_type"))
            full = every.join(state, "holder", "left").join(before, "holder", "left")
            following = stored(full.select("root", "alias", "holder", F.when(F.col("_t").isNotNull(), F.col("_q")).otherwise(F.col("holder_qid")).alias("holder_qid"), F.coalesce("_t", "holder_type").alias("holder_type")))
            if holders is not None:
                discard(holders)
            holders = following
    if not done:
        return left.select("entity_id", F.lit("kept").alias("outcome"), F.lit(None).cast("long").alias("into"))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return stored(result.where("kind = 'entity'").select("entity_id", "outcome", "into"))


def plan(entities: DataFrame, mentions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each entity with the name and aliases that its spellings give today, and what is to become of it."""
    new = derived(mentions)
    e = entities.join(new.withColumnsRenamed({"name": "_name", "aliases": "_aliases"}), "entity_id", "left")
    spelt = F.col("_name").isNotNull()
    e = stored(e.withColumns({"name": F.coalesce("_name", "name"), "aliases": F.array_sort(F.coalesce("_aliases", "aliases")), "spelt": spelt, "related": F.coalesce("related", F.lit(True))}).drop("_name", "_aliases"))
    return e.join(decided(e, chunk), "entity_id")


def repaired(planned: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and mentions (event_id, entity_id, surface) after the plan.

    A survivor unites aliases, sums mentions, keeps the best confidence and the widest time, and takes a type and an id
    from the first of its own that has one. A mention moves with its entity; where the survivor has it already, it is one.
    Flagged entities go to review unless a person has decided them; a reason that the name names several things takes their id.
    """
    to = F.when(F.col("outcome") == "merged", F.col("into")).otherwise(F.col("entity_id"))
    rows = planned.withColumn("_to", to)
    order = F.struct(F.col("entity_id") != F.col("_to"), -F.col("mention_count"), "name", "entity_id")
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, order)).alias(c)
    own = F.col("entity_id") == F.col("_to")
    kept = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    aliases = rows.select("_to", F.explode("aliases").alias("x")).distinct().groupBy("_to").agg(F.array_sort(F.collect_list("x")).alias("aliases"))
    out = rows.groupBy("_to").agg(
        kept("name"), F.sum("mention_count").alias("mention_count"), F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        first("type", F.col("type") != "unknown"), first("qid", F.col("qid").isNotNull()), kept("review_status"), kept("risk"), kept("outcome"),
    )
    flagged = ~F.col("outcome").isin("kept", "merged") & ~F.coalesce(F.col("review_status").isin(*DECIDED), F.lit(False))
    vague = flagged & (F.col("outcome") == "unrelated_names")
    out = out.join(aliases, "_to", "left").select(
        F.col("_to").alias("entity_id"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "mention_count", "confidence", "first_seen", "last_seen", F.coalesce("type", F.lit("unknown")).alias("type"),
        F.when(~vague, F.col("qid")).alias("qid"), F.when(flagged, "needs_review").otherwise(F.col("review_status")).alias("review_status"),
        F.when(vague | (flagged & F.col("risk").isNull()), F.col("outcome")).otherwise(F.col("risk")).alias("risk"),
    )
    moved = mentions.join(rows.select("entity_id", "_to"), "entity_id", "left").select("event_id", F.coalesce("_to", "entity_id").alias("entity_id"), "surface").distinct()
    return out, moved
