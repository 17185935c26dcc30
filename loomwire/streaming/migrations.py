"""Schema versions of stored tables: steps up and down that rewrite data as plans.

A step is a name, and for each table that it changes the plan up and the plan down. A table's data and version change
together, in a manifest's one step, so a migration that is stopped leaves the version before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.storage import Manifests

Plan = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    up: dict[str, Plan] = field(default_factory=dict)
    down: dict[str, Plan] = field(default_factory=dict)


class Store:
    """Tables in a folder, with the number of steps that they have gone through."""

    def __init__(self, spark: SparkSession, root: str, steps: list[Step]) -> None:
        self.spark, self.root, self.steps = spark, root.rstrip("/"), steps
        self._manifests = Manifests(spark, root)

    def state(self) -> dict:
        return self._manifests.newest() or {"change": 0, "version": 0, "tables": {}}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.state()["tables"][name])

    def put(self, tables: dict[str, DataFrame], version: int | None = None) -> None:
        """New contents of tables, at the version given or as it is."""
        state = self.state()
        paths = dict(state["tables"])
        for name, rows in tables.items():
            paths[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(paths[name])
        after = {"change": state["change"] + 1, "version": state["version"] if version is None else version, "tables": paths}
        self._manifests.publish(after["change"], after)

    def migrate(self, to: int | None = None) -> list[str]:
        """Goes up or down to a version, the newest if none is given, and says which steps it took."""
        to, taken = len(self.steps) if to is None else to, []
        if not 0 <= to <= len(self.steps):
            raise ValueError(f"there are versions 0 to {len(self.steps)}")
        while (now := self.state()["version"]) != to:
            up = now < to
            step = self.steps[now if up else now - 1]
            plans = step.up if up else step.down
            self.put({name: plan(self.table(name)) for name, plan in plans.items()}, now + 1 if up else now - 1)
            taken.append(step.name if up else f"-{step.name}")
        return taken


def _unlinked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("qid_status", F.when(F.col("qid_status") == "duplicate", "pending").otherwise(F.col("qid_status")))


#: The steps of the news store that rewrite rows: links get a state, and verdicts and states that an older version
#: doesn't know go when it comes back.
STEPS = [
    Step("link_states", {"entities": lambda e: e.withColumn("qid_status", F.when(F.col("qid").isNotNull(), "linked").otherwise("pending"))}, {"entities": lambda e: e.drop("qid_status")}),
    Step("off_topic_verdicts", {}, {"verdicts": lambda v: v.where("verdict IS NULL OR verdict <> 'off_topic'")}),
    Step("duplicate_links", {}, {"entities": _unlinked}),
]
