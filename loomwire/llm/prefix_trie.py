"""The prefix trie of conversations, from double arrays (operator 12).

A conversation is a path of turns, and a trie node a distinct prefix. Paths are cut into segments of `LEVELS` turns, so
that none is long, and equal segments below one prefix are one, with a count. Sorted by prefix and turns and dealt by
range, neighbours share their prefixes, and a prefix that very many conversations have is simply spread over several
ranges. Each range is a shard, or several of bounded size: its turns get dense ids, and its segments a double array.
The slot of a state's child by turn x is BASE[state] + x, and CHECK there holds the state that owns it. Walking the
segments through the arrays gives each state's members; what a shard knows of a node is merged globally by the node's
key, since upper nodes occur in many shards.

A node's key is the sum of a 128-bit hash of each turn with its depth, so that keys of long conversations are running
sums by blocks. Numbers over whole subtrees need no walk from level to level: a node belongs to its smallest member, and
a conversation's own nodes are the lower end of its path; so a subtree is the rest of the owner's own path, and all own
nodes of the other members, which are summed once for each member and added to the prefixes that it shares.

Conversations are rebuilt before: a few turns of another conversation take the place of a conversation's first ones.

Defined results: a null role or text is empty; rows without a conv_id take no part; turns sort by turn (nulls first),
then by the digest of role and text; repeated rows are turns each; the source of c is c - c % 20 with the sign of c; an
empty table gives no rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm._common import read, running_before
from loomwire.storage import discard, stored

#: Turns in a segment, segments in a double array, depths in a block of the running sums, ids in a block of an end list.
LEVELS, SEGMENTS, BLOCK, IDS = 16, 20_000, 512, 1024
EVERY, HEADS = 20, 4
LANES = ("_a", "_b", "_c", "_d")
_ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, p (from 0), t (digest of role and text) and w (words of the text) of each turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", digest.alias("t"), words.alias("w"), F.floor(F.col("turn") / BLOCK).alias("_block"))
    return running_before(rows, ["conv_id"], "_block", [F.col("turn").asc_nulls_first(), F.col("t")], {"p": F.lit(1).cast("long")}).select("conv_id", "p", "t", "w")


def rebuilt(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their turns (conv_id, d, t, w) after the first ones were replaced.

    The first h turns are those of the conversation c - c % every, h being the CRC of c, mod `heads`.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    head = turns.where((F.col("conv_id") % every == 0) & (F.col("p") < heads - 1)).groupBy(F.col("conv_id").alias("source"))
    head = head.agg(F.array_sort(F.collect_list(F.struct("p", "t", "w"))).alias("head"))  # heads - 1 turns at most
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("source"))
    convs = convs.join(head, "source", "left").select("conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array().cast(head.schema["head"].dataType)).alias("head"))
    convs = stored(convs)
    taken = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", (F.col("x.p") + 1).alias("d"), F.col("x.t").alias("t"), F.col("x.w").alias("w"))
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where(F.col("p") >= F.col("h"))
    return convs, taken.unionByName(own.select("conv_id", (F.col("p") - F.col("h") + F.col("n") + 1).alias("d"), "t", "w"))


def _packed(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.pmod(x, F.lit(1 << 32))), 8, "0") for x in lanes]))


def keyed(turns: DataFrame) -> DataFrame:
    """turns (conv_id, d, t, w) with key, that of the prefix that ends here, and parent, that of the one before."""
    lane = lambda n: F.conv(F.substring(F.col("_x"), 8 * n + 1, 8), 16, 10).cast("long")
    rows = turns.withColumn("_x", F.md5(F.concat("t", F.col("d").cast("string").cast("binary"))))
    rows = rows.select("conv_id", "d", "t", "w", *[lane(i).alias(x) for i, x in enumerate(LANES)], F.floor(F.col("d") / BLOCK).alias("_block"))
    rows = running_before(rows, ["conv_id"], "_block", [F.col("d")], {f"{x}s": F.col(x) for x in LANES})
    before, after = [F.col(f"{x}s") for x in LANES], [F.col(f"{x}s") + F.col(x) for x in LANES]
    return rows.select("conv_id", "d", "t", "w", _packed(after).alias("key"), _packed(before).alias("parent"))


def segments(turns: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Distinct segments (parent, path, at, words, keys) with the number of their conversations and the smallest one.

    at is the depth of the first turn. Copies meet by the key of their last turn, which stands for the whole prefix.
    """
    cut = turns.groupBy("conv_id", F.floor((F.col("d") - 1) / levels).alias("_band")).agg(F.array_sort(F.collect_list(F.struct("d", "t", "w", "key"))).alias("s"), F.min_by("parent", "d").alias("parent"))
    one = cut.groupBy(F.element_at("s", -1)["key"].alias("_last")).agg(F.any_value("s").alias("s"), F.any_value("parent").alias("parent"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    part = lambda name: F.transform("s", lambda x: x[name])
    return one.select("parent", part("t").alias("path"), F.get("s", F.lit(0))["d"].alias("at"), part("w").alias("words"), part("key").alias("keys"), "n", "least")


class DoubleArray:
    """A trie of sequences of dense ids, sorted, in two arrays."""

    def __init__(self, paths: list[list[int]]) -> None:
        self.base, self.check = [0], [0]  # the root owns slot 0, so that no child is put there
        self.free = 1
        work = [(0, 0, len(paths), 0)]
        while work:
            state, low, high, depth = work.pop()
            while low < high and len(paths[low]) == depth:
                low += 1
            children, at = [], low
            while at < high:
                x, start = paths[at][depth], at
                while at < high and paths[at][depth] == x:
                    at += 1
                children.append((x, start, at))
            if children:
                base = self._place(sorted(x for x, _, _ in children))
                self.base[state] = base
                for x, start, end in children:
                    self.check[base + x] = state
                    work.append((base + x, start, end, depth + 1))

    def _place(self, ids: list[int]) -> int:
        """A base where all the ids' slots are free: in the first gaps, or else behind all that is taken."""
        base, check = self.base, self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        slot, tries = self.free, 0
        # many children seldom fit a gap, and a search that goes on would make building quadratic
        while len(ids) <= 8 and tries < 32 and slot < len(check):
            if check[slot] < 0 and all(slot - ids[0] + x >= len(check) or check[slot - ids[0] + x] < 0 for x in ids):
                break
            slot, tries = slot + 1, tries + 1
        else:
            slot = len(check)
        start = slot - ids[0]
        if (need := start + ids[-1] + 1 - len(check)) > 0:
            base.extend([0] * need)
            check.extend([-1] * need)
        return start

    def walk(self, path: list[int]) -> Iterator[int]:
        """The states along a path, as far as it is there."""
        state = 0
        for x in path:
            slot = self.base[state] + x
            if not 0 < slot < len(self.check) or self.check[slot] != state:
                return
            state = slot
            yield state


NODES = "key binary, parent binary, depth long, words long, n_convs long, conv_id long"


def _shard(rows: list[tuple]) -> pa.RecordBatch:
    """What sorted segments know of their nodes."""
    ids: dict[bytes, int] = {}
    paths = [[ids.setdefault(x, len(ids)) for x in (b"/" + parent, *path)] for parent, path, *_ in rows]
    trie = DoubleArray(paths)
    n, least, seen = [0] * len(trie.check), [0] * len(trie.check), [None] * len(trie.check)
    for (parent, _, at, words, keys, count, smallest), path in zip(rows, paths, strict=True):
        states = trie.walk(path)
        next(states)  # the state of the prefix, whose numbers are those of the segment before
        for i, state in enumerate(states):
            if seen[state] is None:
                seen[state] = (keys[i], keys[i - 1] if i else parent, at + i, words[i])
                least[state] = smallest
            n[state] += count
            least[state] = min(least[state], smallest)
    at = [s for s, x in enumerate(seen) if x is not None]
    key, parent, depth, words = zip(*[seen[s] for s in at], strict=True)
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((key, parent, depth, words, [n[s] for s in at], [least[s] for s in at]), kinds, strict=True)], ["key", "parent", "depth", "words", "n_convs", "conv_id"])


def shards(cut: DataFrame, size: int = SEGMENTS) -> DataFrame:
    """Nodes below the root as each shard knows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            while len(rows) >= size:
                yield _shard(rows[:size])
                rows = rows[size:]
        if rows:
            yield _shard(rows)

    dealt = cut.repartitionByRange("parent", "path").sortWithinPartitions("parent", "path")
    return dealt.select("parent", "path", "at", "words", "keys", "n", "least").mapInArrow(run, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """One row a node."""
    return nodes.groupBy("key").agg(F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def ends(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the ids of the conversations that end at a node.

    Ids are joined by blocks of `IDS` numbers, in Spark, and the blocks of a node are hashed one after the other, so a
    node where very many conversations end is a stream of strings, never a list.
    """
    last = turns.groupBy("conv_id").agg(F.max_by("key", "d").alias("key"))
    at = convs.select("conv_id").join(last, "conv_id", "left").select(F.coalesce("key", F.lit(_ROOT)).alias("key"), "conv_id", F.floor(F.col("conv_id") / IDS).alias("block"))
    parts = at.groupBy("key", "block").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, out = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        out.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(ids.as_buffer())
                else:
                    digest.update(b",")
                    digest.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return parts.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes with their subtrees' numbers; turns (keyed) and convs are stored tables."""
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = top.select(F.lit(_ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")
    nodes = stored(merged(shards(stored_segments := stored(segments(turns)))).unionByName(top))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = full.select("*", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (-F.floor(F.col("depth") / BLOCK)).alias("_block"))
    full = stored(full)
    # a node's owner is its smallest member: below it, the rest of the owner's own nodes
    below = running_before(full, ["conv_id"], "_block", [F.desc("depth")], {"leaves_below": F.col("leaf"), "saved_below": F.col("saved")})
    # and all own nodes of every other member, which are added to each prefix that it only shares
    chains = stored(full.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")))
    shared = turns.select("conv_id", "d", "key").join(chains, "conv_id").where("d < top").select("key", "leaf", "saved")
    shared = shared.unionByName(chains.where("top > 0").select(F.lit(_ROOT).alias("key"), "leaf", "saved"))
    other = shared.groupBy("key").agg(F.sum("leaf").alias("leaves_other"), F.sum("saved").alias("saved_other"))
    parents = full.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = below.join(parents, "parent", "left").join(other, "key", "left").join(ends(convs, turns), "key", "left")
    none = F.lit(0).cast("long")
    out = stored(
        out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.col("leaves_below") + F.coalesce("leaves_other", none)).alias("n_leaves"),
            (F.col("saved") + F.col("saved_below") + F.coalesce("saved_other", none)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), F.lower(F.hex("key")).alias("key"),
        )
    )
    discard(stored_segments, nodes, full, chains)
    return out


def build(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text); `key` names a node."""
    turns = stored(ordered(conversations))
    convs, paths = rebuilt(turns)
    paths = stored(keyed(paths))
    out = trie(convs, paths)
    discard(turns, convs, paths)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("key")


#: The CRC of a decimal id as in operator 4; a node is its turns' digests in a row.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT n, n AS c, 0 AS i FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8
), crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE i = 8),
t AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, t, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS p FROM t
), i AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM o),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS source, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda j: ascii(s[j])::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM i, crc
), r AS (
  SELECT c.conv_id, o.p, o.t, o.w FROM c JOIN o ON o.conv_id = c.source AND o.p < c.h
  UNION ALL SELECT c.conv_id, o.p + 4, o.t, o.w FROM c JOIN o ON o.conv_id = c.conv_id AND o.p >= c.h
), k AS (
  SELECT conv_id, row_number() OVER w1 AS d, w, array_to_string(list(t) OVER w1, '/') AS path FROM r WINDOW w1 AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h FROM (SELECT conv_id, arg_max(path, d) AS path FROM k GROUP BY conv_id) GROUP BY path),
up AS (SELECT DISTINCT k.path, q.path AS parent FROM k JOIN k q ON q.conv_id = k.conv_id AND q.d = k.d - 1),
n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM k GROUP BY path),
f AS (SELECT n.*, up.parent, (SELECT count(*) FROM up x WHERE x.parent = n.path) AS n_children FROM n LEFT JOIN up USING (path)),
s AS (SELECT DISTINCT a.path AS top, b.path FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.d >= a.d),
z AS (SELECT s.top AS path, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.w)::BIGINT AS saved_tokens FROM s JOIN f ON f.path = s.path GROUP BY s.top)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, z.n_leaves, z.saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM f JOIN z USING (path) LEFT JOIN f g ON g.path = f.parent LEFT JOIN e ON e.path = f.path
"""
