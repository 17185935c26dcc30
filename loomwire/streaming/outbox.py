"""The signals' outbox: rows land as JSON lines, and each signal is announced once.

What was announced is a table that takes each micro-batch once, so neither a restart, a stream that begins anew, nor a
signal that lands twice announces it again. A sweep finds what no stream has seen, oldest first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.storage import discard, stored
from loomwire.streaming.ledger import Ledger, writer_of

SIGNAL = "signal_id string, kind string, created_at timestamp, cluster_id string, event_id string, title string, score double"
ANNOUNCED = f"{SIGNAL}, swept boolean"
LINES = "value string"


def append(signals: DataFrame, path: str) -> None:
    """Signals (the columns of SIGNAL, nulls kept) as JSON lines in files of their own."""
    names = [x.split()[0] for x in SIGNAL.split(", ")]
    signals.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def announced(spark: SparkSession, root: str) -> Ledger:
    return Ledger(spark, root, {"announced": ("signal_id", ANNOUNCED), "rejected": ("value", "value string, reason string")})


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signals of lines (value), the first of each id; and the lines that are none, with the reason."""
    rows = lines.select("value", F.from_json("value", SIGNAL, {"mode": "PERMISSIVE"}).alias("s"))
    reason = F.when(F.col("s").isNull() | F.col("s.signal_id").isNull(), "no signal id").when(~F.col("s.kind").isin("weak_signal", "trend_breakout", "beat_match"), "unknown kind").when(
        F.col("s.cluster_id").isNull() & F.col("s.event_id").isNull(), "nothing to refer to"
    )
    rows = rows.withColumn("reason", reason)
    first = Window.partitionBy("signal_id").orderBy(F.col("created_at").asc_nulls_last(), "value")
    good = rows.where("reason IS NULL").select("value", "s.*").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "value")
    return good, rows.where("reason IS NOT NULL").select("value", "reason").dropDuplicates(["value"])


def _announce(into: Ledger, lines: DataFrame, number: int, writer: str, most: int | None = None) -> DataFrame | None:
    if into.applied(number, writer):
        return None
    good, bad = parsed(lines)
    new = good.join(into.table("announced").select("signal_id"), "signal_id", "left_anti")
    if most:
        new = new.orderBy(F.col("created_at").asc_nulls_last(), "signal_id").limit(most)
    new = stored(new.withColumn("swept", F.lit(most is not None)))
    into.commit(number, {"announced": new, "rejected": bad}, writer)
    return new


def announcing(into: Ledger, tell: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink. `tell` gets the signals that are announced, after they are noted, so none is told twice."""

    def sink(batch: DataFrame, number: int) -> None:
        new = _announce(into, batch, number, writer_of(batch))
        if new is not None:
            if tell:
                tell(new)
            discard(new)

    return sink


def sweep(spark: SparkSession, path: str, into: Ledger, most: int = 50, tell: Callable[[DataFrame], None] | None = None) -> int:
    """Announces the oldest signals that no stream has, `most` at once, and says how many there were."""
    number = into.state()["batches"].get("sweep", -1) + 1
    new = _announce(into, spark.read.text(path), number, "sweep", most)
    if new is None:
        return 0
    n = new.count()
    if tell and n:
        tell(new)
    discard(new)
    return n
