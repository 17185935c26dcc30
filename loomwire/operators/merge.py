"""Keyed merges as joins and rewrites, delivery state and verdict state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.params import DEFAULTS, Params


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet; of a repeated key the last by the tie-break column _seq."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_seq")))).where("_r = 1").drop("_r")
    return last.join(old.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Old rows with `update` columns from new ones where keys meet, and the new rows; one full outer join."""
    o, n = old.alias("o"), new.alias("n")
    on = None
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = c if on is None else on & c
    there = F.col("n._there").isNotNull()
    n = new.withColumn("_there", F.lit(True)).alias("n")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in update:
            columns.append(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c))
    return o.join(n, on, "full_outer").select(*columns)


def mirror(old: DataFrame, remote: DataFrame, key: str, active: str = "active") -> DataFrame:
    """Remote rows are active; old ones that the remote list lacks stay, inactive."""
    o, r = old.alias("o"), remote.alias("r")
    rest = [c for c in old.columns if c not in (key, active)]
    seen = F.col(f"r.{key}").isNotNull()
    return o.join(r, F.col(f"o.{key}") == F.col(f"r.{key}"), "full_outer").select(
        F.coalesce(f"r.{key}", f"o.{key}").alias(key), *[F.when(seen, F.col(f"r.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest], seen.alias(active)
    )


def status_by_age(last_seen: Column, as_of: datetime, params: Params = DEFAULTS) -> Column:
    return F.when(F.unix_timestamp(last_seen) >= int(as_of.timestamp()) - params.dormant_days * 86400, "active").otherwise("dormant")


def newest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def signal_status(verdict: Column, now: Column) -> Column:
    """Only a true or false verdict moves a signal."""
    return F.when(verdict == "true_signal", "confirmed").when(verdict == "false_signal", "dismissed").otherwise(now)


def outcome(code: Column) -> Column:
    """What a webhook's answer means: 2xx delivered, 5xx and 408, 425, 429 (or none) to try again, else failed."""
    return F.when(code.between(200, 299), "delivered").when(code.isNull() | (code >= 500) | code.isin(408, 425, 429), "pending").otherwise("failed")


def next_delay(attempts: Column, params: Params = DEFAULTS) -> Column:
    """Seconds to the next attempt after so many, null when there is none."""
    steps = F.array(*[F.lit(s) for s in params.retry_seconds])
    return F.when(attempts > 0, F.try_element_at(steps, attempts.cast("int")))


def collisions(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Rows whose key an earlier row (by `by`) holds: duplicates to review."""
    w = Window.partitionBy(key).orderBy(by)
    return rows.where(F.col(key).isNotNull()).withColumn("place", F.row_number().over(w)).withColumn("keeper", F.first(by).over(w)).where(F.col("place") > 1)


def absorb(entities: DataFrame, survivors: DataFrame) -> DataFrame:
    """Entities merged into survivors (entity_id, survivor): aliases united, mentions summed, seen widened."""
    rows = entities.join(survivors, "entity_id", "left").withColumn("survivor", F.coalesce("survivor", "entity_id"))
    return rows.groupBy("survivor").agg(
        F.min_by("name", F.struct(F.col("entity_id") != F.col("survivor"), "entity_id")).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("confidence").alias("confidence"),
    )
