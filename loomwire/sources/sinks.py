"""Sinks: JSON lines, keyed appends, versioned tables, an outbox and its delivery, alert texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomwire.operators.merge import next_delay, outcome
from loomwire.operators.views import to_json_lines


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a row, nulls kept."""
    to_json_lines(rows).write.mode("overwrite").text(path)


def write_version(rows: DataFrame, root: str) -> str:
    """A new version of a table in a folder of its own; readers of older versions are not disturbed."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def append_absent(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table lacks, and gives them back; run again, it adds nothing."""
    spark: SparkSession = rows.sparkSession
    new = rows.dropDuplicates([key]).join(spark.read.parquet(path).select(key), key, "left_anti")
    added = spark.read.schema(rows.schema).parquet(write_version(new.select(*rows.columns), f"{path.rstrip('/')}-added"))
    added.write.mode("append").parquet(path)
    return added


def deliver(outbox: DataFrame, post: Callable[[Iterator[Row]], Iterator[tuple[int, int | None]]], into: str) -> DataFrame:
    """Delivery outcomes of an outbox (id, payload, attempts): `post` sends a partition's rows and gives (id, code).

    Outcomes are written before they are read, so a row is sent once a run, and a lost task repeats only its own rows.
    """
    sent = outbox.rdd.mapPartitions(post).toDF("id long, code int")
    done = outbox.sparkSession.read.schema("id long, code int").parquet(write_version(sent, into))
    out = outbox.join(done, "id").withColumn("attempts", F.col("attempts") + 1).withColumn("status", outcome(F.col("code")))
    return out.withColumn("next_delay", F.when(F.col("status") == "pending", next_delay(F.col("attempts")))).withColumn("status", F.when((F.col("status") == "pending") & F.col("next_delay").isNull(), "failed").otherwise(F.col("status")))


def alert_text(kind: Column, title: Column, score: Column, link: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("["), F.upper(kind), F.lit("] "), title), F.when(score.isNotNull(), F.format_string("score %.2f", score)), link)
