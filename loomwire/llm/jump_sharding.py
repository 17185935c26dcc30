"""Jump consistent hashing (operator 4, DataFrame functions only).

A row's shard follows from its key and the shard count alone: no ring, no table, no shuffle. One more shard takes over
1/(n+1) of the keys and no row moves between old shards (Lamping and Veach, 2014). The generator is the paper's 64-bit
linear congruential one, computed in 32-bit halves because ANSI arithmetic refuses to overflow.

Law: `key`. Defined results: a null key counts as 0; a null text has no bytes and CRC 0; rows with equal keys share a
shard; identical rows get consecutive slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.llm._common import read

SHARDS = 8
_MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the bucket of `key` among `shards`, and among one more."""
    if not 1 <= shards <= 4096:
        raise ValueError("shards must be in 1..4096")
    c = [(_MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]

    def step(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        p0, p1 = lo * c[0], lo * c[1]
        low = p0.bitwiseAND(F.lit(_LOW)) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + 1
        high = (
            F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(low, 32) + (lo * c[2]).bitwiseAND(F.lit(_LOW))
            + F.shiftleft((lo * c[3]).bitwiseAND(F.lit(0xFFFF)), 16) + (hi * c[0]).bitwiseAND(F.lit(_LOW)) + F.shiftleft((hi * c[1]).bitwiseAND(F.lit(0xFFFF)), 16)
        )
        low, high = low.bitwiseAND(F.lit(_LOW)), high.bitwiseAND(F.lit(_LOW))
        nxt = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), nxt.alias("j"), low.alias("lo"), high.alias("hi")))

    long = lambda x: F.lit(x).cast("long")
    start = F.struct(long(-1).alias("b"), long(0).alias("j"), key.bitwiseAND(F.lit(_LOW)).alias("lo"), F.shiftrightunsigned(key, 32).alias("hi"))
    # j rises with every step, so as many steps as shards always suffice
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.struct(s["b"].cast("int").alias("shard"), F.when(s["j"] == shards, F.lit(shards)).otherwise(s["b"].cast("int")).alias("grown")))


def assign(df: DataFrame, key: str, shards: int = SHARDS, into: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """The rows with their shard among `shards` and among one more; each row by itself."""
    at = jump(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), shards)
    return df.withColumn("_jump", at).select(*[c for c in df.columns if c not in (into, grown)], F.col("_jump.shard").alias(into), F.col("_jump.grown").alias(grown))


def slots(df: DataFrame, columns: list[str], shard: str = "shard", digits: int = 3) -> DataFrame:
    """Rows of `columns` with a slot, gapless from 0 in each shard.

    Equal rows are counted before the shuffle and spread out after it. A shard's rows are numbered inside 16**digits
    buckets of their digest, so no task holds a shard; only the buckets' totals meet per shard.
    """
    digest = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, digits)
    counted = df.groupBy(shard, *columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", digest)
    inside = Window.partitionBy(shard, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in columns]).rowsBetween(Window.unboundedPreceding, -1)
    rows = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    across = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("_n").alias("_t"))
    totals = totals.select("_s", "_b", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base"))
    rows = rows.join(totals, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return rows.select(shard, *columns, F.explode(F.sequence(F.col("_base") + F.col("_before"), F.col("_base") + F.col("_before") + F.col("_n") - 1)).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = slots(assign(slim, "doc_id"), ["doc_id", "size", "text_crc32", "grown_shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The CRC runs over a text's bytes with the usual 256-entry table; the generator's state is an unsigned 64-bit number.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT n, n AS c, 0 AS i FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8
), crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE i = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT d.rid, d.doc_id, d.size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc
), walk AS (
  SELECT rid, (coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END)::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT rid, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n // 8589934592::UHUGEINT) + 1)::DOUBLE))::BIGINT
  FROM (SELECT rid, j, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS n FROM walk WHERE j < 8)
), e AS (SELECT rid, b, j FROM walk WHERE j >= 8),
r AS (
  SELECT doc_id, size, text_crc32, b::INT AS shard, (CASE WHEN j = 8 THEN 8 ELSE b END)::INT AS grown_shard,
    left(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32 || ':' || (CASE WHEN j = 8 THEN 8 ELSE b END)), 3) AS bucket
  FROM s JOIN e USING (rid)
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot, grown_shard
FROM r
"""
