"""Helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.storage import stored  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Keys of at most so many rows (8 bytes each) are broadcast; more of them are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def few(keys: DataFrame) -> bool:
    """Whether a stored table of keys has at most so many rows as may be broadcast."""
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `key` is among wanted's (one column of that name, stored).

    Few keys go out as hashes, so the rows stay where they are; a hash that meets by chance lets a row through, and
    the caller's join drops it. The count is checked first, and beyond the bound the rows are shuffled.
    """
    if few(wanted):
        hashed = wanted.select(F.xxhash64(key).alias("_h"))
        return rows.join(F.broadcast(hashed), F.xxhash64(rows[key]) == hashed["_h"], "left_semi")
    return rows.join(wanted, key, "left_semi")


def running_before(df: DataFrame, keys: list[str], block: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """For each row the sums over all earlier rows of its key, without one task per key.

    `block` must not fall as `order` rises. Rows are summed inside (key, block) and the blocks' totals, far fewer, inside
    the key; both windows on the large side and the join share one exchange.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    across = Window.partitionBy(*keys).orderBy(F.col(block).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, block])], *[F.coalesce(F.sum(f"_t_{k}").over(across), F.lit(0)).alias(f"_b_{k}") for k in sums])
    local = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{k}") for k, c in sums.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, block])]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = local.join(totals, on, "inner")
    return joined.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])
