"""Near-duplicate documents by Order MinHash (operator 7).

A document's k-mers are its word five-grams, each labelled with its occurrence number. A sketch draws the few k-mers of
least hash under its own seed and keeps them in text order, so it is sensitive to edits and moves, not only to the
set (Marcais et al., 2019). Texts that share one of the sketches are candidates, verified by banded alignment of their
word sequences: near duplicates have an edit similarity 1 - distance / longer length of at least 0.8.

Texts of at most `SHORT` words are also bucketed by the segments of the edit join of operator 2, on words, which miss no
pair among them. Lengths and parity bits of the words, both bounds of the distance, rule pairs out before any text is
fetched.

Equal texts are one node, so a group of copies costs no pair. First every text of a bucket meets the bucket's leader,
its least text, and in large buckets then some texts of the bucket's largest class; a group of near copies is one class
after that, but for strays. Then texts of one bucket that are in different classes meet. In buckets of more than `SMALL` texts only those do that share one of their rarest words, so many of each
text's that two texts without a common one can't be similar (the prefix filter of exact set joins): no link is lost, and
a passage that many texts hold makes no pairs. Classes are connected components.

Defined results: a null text is empty; texts of fewer than five words are one k-mer, texts without words match only
their equals; null doc_ids are grouped and never name a class unless all ids are null; repeated rows are copies; an
empty table gives no rows; other columns are ignored (`query`) or kept (`keep_first`).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwire.llm._common import few, only, read
from loomwire.llm.banded import within
from loomwire.llm.line_dedup import probes, segments
from loomwire.operators.graph import components, extended, spread
from loomwire.storage import discard, stored

WORDS, SKETCHES, DRAWN, SIMILARITY = 5, 96, 2, 0.8
#: Pairs of texts of at most so many words are found without sketches.
SHORT = 24
#: Parity bits of a text's words.
BITS = 512
#: In buckets of more texts, pairs are looked for by rare words; both ways give the same links.
SMALL = 32
#: So many of a large bucket's largest class meet each other text of it before rare words are looked at.
MET = 2
#: Words before a rare word that are kept with it.
WINDOW = 16
#: Counters that order words by frequency and tell those of one class; 9 bytes each, whatever the input.
COUNTERS = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = {}


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    if count not in _SEEDS:
        drawn = _mix(np.arange(1, count + 1, dtype=np.uint64) * _MULTIPLIERS[0])
        _SEEDS[count] = drawn.astype(np.uint32)[:, None], ((drawn >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
    return _SEEDS[count]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def kmers(one: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of word hashes, each with its occurrence number."""
    grams = np.zeros(max(0, len(one) - k + 1), np.uint64)
    for i in range(k):
        grams += _mix(one[i : i + len(grams)] + np.uint64(i + 1)) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = ranked[1:] != ranked[:-1]
    if not new.all():
        starts = np.flatnonzero(np.concatenate([[True], new]))
        label = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
        grams[order] += _mix(label.astype(np.uint64)) * (label > 0)
    return grams


def sketches(one: np.ndarray, k: int = WORDS, count: int = SKETCHES, drawn: int = DRAWN) -> np.ndarray:
    """`count` sketches of word hashes as signed 64-bit numbers; none for a text without words."""
    if not len(one):
        return np.zeros(0, np.int64)
    grams = kmers(one, min(k, len(one)))
    high = (grams >> np.uint64(32)).astype(np.uint32)
    xors, odds = _seeds(count)
    n, key = min(drawn, len(grams)), np.arange(count, dtype=np.uint64)
    at = np.empty((count, n), np.int64)
    step = max(1, 50_000 // len(grams))
    for low in range(0, count, step):  # what is worked on stays in the cache
        h = (high ^ xors[low : low + step]) * odds[low : low + step]
        rows = np.arange(len(h))
        for i in range(n):
            at[low : low + step, i] = least = h.argmin(axis=1)
            h[rows, least] = np.uint32(2**32 - 1)
    at.sort(axis=1)
    for i in range(n):
        key = _mix(key * _MULTIPLIERS[1] + grams[at[:, i]])
    return key.view(np.int64)


@cache
def _short_plan(n: int, similarity: float) -> list[tuple[int, int, int]]:
    """(seed, start, end) of the segments that a text of n words has, and of those that it looks up."""

    def edits(longer: int) -> int:
        return int((1 - similarity) * longer + 1e-9)

    own = {(e, n, i, at, k) for longer in range(n, SHORT + 1) if longer - n <= (e := edits(longer)) for i, (at, k) in enumerate(segments(n, e))}
    asked = {(edits(n), m, i, at, k) for m, i, at, k in probes(n, edits(n), 1)}
    return [(e << 32 | m << 16 | i, at, at + k) for e, m, i, at, k in sorted(own | asked)]


def short_keys(words: list[bytes], similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of which any two texts of at most SHORT words that are similar enough share one; none for longer texts."""
    from xxhash import xxh3_64_intdigest as digest

    if not 0 < len(words) <= SHORT:
        return np.zeros(0, np.int64)
    keys = {digest(b" ".join(words[p:q]), seed) for seed, p, q in _short_plan(len(words), similarity)}
    return np.array(sorted(keys), np.uint64).view(np.int64)


def parity(one: np.ndarray) -> list[int]:
    """Whether the words of each hash value are odd in number, as 64-bit numbers; an edit changes two bits at most."""
    counts = np.bincount((one % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def rare_words_needed(n: int, similarity: float = SIMILARITY) -> int:
    """Of so many of the rarest words of a text of n words, each text that is similar enough has one at least.

    An edit of the longer text, of m words, changes one of them, so m - edits words are common to both.
    """
    common = min((m - int((1 - similarity) * m + 1e-9) for m in range(n, int(n / similarity + 1e-9) + 1)), default=0)
    return max(0, n - max(1, common) + 1)


def _may_be_similar(n: str, m: str, p: str, q: str, similarity: float) -> Column:
    """False only where the lengths n and m or the parity bits p and q rule it out.

    Two texts are at least as many edits apart as one has words that the other hasn't: half of all words that they don't
    share and of the difference of their lengths.
    """
    apart = sum((F.bit_count(F.col(p)[i].bitwiseXOR(F.col(q)[i])) for i in range(BITS // 64)), F.lit(0))
    longer = F.greatest(n, m)
    edits = F.floor((1 - similarity) * longer + F.lit(1e-9))
    return (longer - F.least(n, m) <= edits) & (apart + longer - F.least(n, m) <= 2 * edits)


def sketched(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, t (the text's digest), n (words), s (bucket keys) and p (parity) of every row; a pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n, s, odd = [], [], []
                for text in batch.column("text"):
                    words = (text.as_py() or "").encode("utf-8", "replace").split()
                    one = word_hashes(words)
                    n.append(len(words))
                    s.append(np.concatenate([sketches(one), short_keys(words, similarity)]))
                    odd.append(parity(one))
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, s)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *s])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int32()), keys, pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "t", "n", "s", "p"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.md5(text).alias("t"), text.alias("text")).mapInArrow(run, "doc_id long, t string, n int, s array<long>, p array<long>")


def common_words(words: list[bytes], other: Counter) -> int:
    """How many words two texts have in common, repeated ones as often as both have them; an edit takes one at most."""
    return sum(min(c, other[w]) for w, c in Counter(words).items() if w in other)


def similar(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The edges (a, b, further columns) whose texts are similar enough, by banded alignment; texts has t and text.

    Pairs with too few words in common for any alignment are ruled out by their counts of words.
    """
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list[bytes], Counter] = ("", [], Counter())
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                if last[0] != (right := y.as_py()):
                    words = right.encode("utf-8", "replace").split()
                    last = (right, words, Counter(words))
                p, q = x.as_py().encode("utf-8", "replace").split(), last[1]
                longer = max(len(p), len(q))
                edits = int((1 - similarity) * longer + 1e-9)
                keep.append(longer - common_words(p, last[2]) <= edits and within(p, q, edits) is not None)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    own = texts.select(F.col("t").alias("a"), F.col("text").alias("_x"))
    other = texts.select(F.col("t").alias("b"), F.col("text").alias("_y"))
    return edges.join(own, "a").join(other, "b").select(*names, "_x", "_y").mapInArrow(run, edges.schema)


def rare_words(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """g, before, t, n, p, root: as many of each text's rarest words as `rare_words_needed` says. rows has t, n, p and root.

    A word that a text repeats counts as so many different ones. Words are ordered by how often these texts hold them,
    estimated by counters of fixed number, then by hash. A word whose counter has seen one root only makes no pair and is
    left out. `before` has the WINDOW words before g among the others: two texts that share one of those have met there,
    so they needn't meet at g.
    """

    names = ["t", "n", "p", "root"]

    def grams(text: pa.Scalar) -> np.ndarray:
        return kmers(word_hashes((text.as_py() or "").encode("utf-8", "replace").split()), 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lo, hi = np.zeros(COUNTERS, np.int64), np.full(COUNTERS, 2**63 - 1), np.full(COUNTERS, -(2**63))
        with np.errstate(over="ignore"):
            for batch in batches:
                for low in range(0, len(batch), 256):
                    some = batch.slice(low, 256)
                    each = [grams(text) for text in some.column("text")]
                    slots = (np.concatenate(each) % np.uint64(COUNTERS)).astype(np.int64)
                    roots = np.repeat(some.column("h").to_numpy(), [len(g) for g in each])
                    np.add.at(total, slots, 1)
                    np.minimum.at(lo, slots, roots)
                    np.maximum.at(hi, slots, roots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at]) for x in (total, lo, hi)]], ["slot", "c", "lo", "hi"])

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mixed = seen.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for low in range(0, len(batch), 256):  # so many texts' words at a time
                    some, take, out, before = batch.slice(low, 256), [], [], []
                    for text, n in zip(some.column("text"), some.column("n").to_pylist(), strict=True):
                        g = grams(text)
                        slots = (g % np.uint64(COUNTERS)).astype(np.int64)
                        rarest = np.lexsort((g, counts[slots]))[: rare_words_needed(n, similarity)]
                        rank = g[rarest[mixed[slots[rarest]]]].view(np.int64)
                        out.append(rank)
                        take.append(len(rank))
                        before += [rank[max(0, i - WINDOW) : i] for i in range(len(rank))]
                    at = pa.array(np.repeat(np.arange(len(some)), take))
                    ends = pa.array(np.cumsum([0, *map(len, before)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *before])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), lists, *[some.column(c).take(at) for c in names]], ["g", "before", *names])

    full = stored(rows.join(texts, "t").select(*names, "text"))
    table, several = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS, bool)
    sums = full.select("text", F.xxhash64("root").alias("h")).mapInArrow(counted, "slot long, c long, lo long, hi long").groupBy("slot")
    sums = sums.agg(F.sum("c").alias("c"), (F.min("lo") != F.max("hi")).alias("several")).toArrow()
    at = sums["slot"].to_numpy()
    table[at], several[at] = sums["c"].to_numpy(), sums["several"].to_numpy()
    seen = rows.sparkSession.sparkContext.broadcast((table, several))
    out = stored(full.mapInArrow(picked, "g long, before array<long>, t string, n int, p array<long>, root string"))
    discard(full)
    return out


def twice(rows: DataFrame, key: str) -> DataFrame:
    """Rows joined with themselves on `key`: t, n, p, root and before of one, u, m, q, v and other of the other.

    Both sides take the same columns under new names, so Spark shuffles them once.
    """
    names = {"t": "u", "n": "m", "p": "q", "root": "v"} | ({"before": "other"} if "before" in rows.columns else {})
    one = rows.select(F.col(key).alias("_x"), *[F.col(c).alias(f"_{c}") for c in names])
    other = rows.select(F.col(key).alias("_y"), *[F.col(c).alias(d) for c, d in names.items()])
    return one.join(other, F.col("_x") == F.col("_y")).select(*[F.col(f"_{c}").alias(c) for c in names], *names.values())


def one_each(rows: DataFrame) -> DataFrame:
    """t, n, s and p of each text once; rows (stored) repeat them for copies.

    Sketches are long, so texts with one row stay where they are, and only the copies' rows are shuffled. Keys of texts
    with copies go out as hashes if they are few (a hash that meets by chance only sends a text to the shuffle).
    """
    copied = stored(rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t"))
    grouped = lambda some: some.groupBy("t").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("p").alias("p"))
    if few(copied):
        hashed = F.broadcast(copied.select(F.xxhash64("t").alias("_h")))
        same = F.xxhash64(rows["t"]) == hashed["_h"]
        out = stored(rows.join(hashed, same, "left_anti").select("t", "n", "s", "p").unionByName(grouped(rows.join(hashed, same, "left_semi"))))
    else:
        out = stored(grouped(rows))
    discard(copied)
    return out


def roots(items: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node and root of every text that has a near duplicate; items has t, n, s and p, one row per text, docs t and text.

    Texts that are connected already are not compared, so a group of copies adds a star, not its pairs.
    """

    def texts(used: DataFrame) -> DataFrame:
        return only(docs, "t", used).dropDuplicates(["t"])

    def verified(edges: DataFrame) -> DataFrame:
        """The similar ones of stored edges (a, b)."""
        ends = edges.select(F.explode(F.array("a", "b")).alias("t"))
        used = ends if few(ends) else stored(ends.distinct())
        fetched = stored(texts(used))
        out = stored(similar(edges, fetched, similarity))
        discard(fetched, *[used][: used is not ends])
        return out

    # digests are spread evenly: the first 28 bits, in the order of the digests, tell a bucket's least text but for a few
    rows = items.select("t", F.conv(F.substring("t", 1, 7), 16, 10).cast("int").alias("h"), "n", "p", F.explode("s").alias("key"))
    buckets = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("h").alias("leader")).where("size > 1"))
    members = stored(rows.join(F.broadcast(buckets) if few(buckets) else buckets, "key"))
    discard(buckets)

    lead = members.where("h = leader").select("key", F.col("t").alias("a"), F.col("n").alias("m"), F.col("p").alias("q"))
    star = members.join(lead, "key").where((F.col("t") > F.col("a")) & _may_be_similar("n", "m", "p", "q", similarity))
    asked = stored(star.select("a", F.col("t").alias("b")).distinct())
    found = verified(asked)
    known = components(found)

    def mixed(rows: DataFrame, known: DataFrame) -> DataFrame:
        """The rows (key, t, ..) of the buckets that hold more than one class, with their classes' roots."""
        now = rows.join(spread(known).select(F.col("node").alias("t"), F.col("root").alias("to")), "t", "left").withColumn("root", F.coalesce("to", "t")).drop("to")
        now = stored(now)
        keys = stored(now.groupBy("key").agg(F.min(F.xxhash64("root")).alias("lo"), F.max(F.xxhash64("root")).alias("hi")).where("lo <> hi").select("key"))
        out = stored(now.join(F.broadcast(keys) if few(keys) else keys, "key"))
        discard(now, keys)
        return out

    # in large buckets every text outside the largest class meets some of that class, so that drifted copies join it
    shared = mixed(members.select("key", "t", "size"), known)
    left = stored(shared.join(items.select("t", "n", "p"), "t"))
    discard(shared, members)
    large = left.where(F.col("size") > SMALL)
    main = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("_m")).select("key", F.col("_m.root").alias("main"))
    large = stored(large.join(main, "key"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("t", "key"), "t"))
    some = large.where("root = main").withColumn("place", place).where(F.col("place") <= MET).select("key", F.col("t").alias("u"), F.col("n").alias("m"), F.col("p").alias("q"))
    met = large.where("root <> main").join(some, "key").where(_may_be_similar("n", "m", "p", "q", similarity))
    met = stored(met.select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b")).distinct().join(asked, ["a", "b"], "left_anti"))
    more = verified(met)
    asked, before = asked.unionByName(met), known
    known = extended(before, more)
    discard(large, found, before, more)
    before, left = left, mixed(left.drop("root"), known)
    discard(before)

    near = twice(left.where(F.col("size") <= SMALL), "key").where((F.col("t") < F.col("u")) & (F.col("root") != F.col("v")) & _may_be_similar("n", "m", "p", "q", similarity))
    near = near.select(F.col("t").alias("a"), F.col("u").alias("b"))

    large = stored(left.where(F.col("size") > SMALL).groupBy("t").agg(*[F.first(c).alias(c) for c in ("n", "p", "root")]))
    rare = rare_words(large, texts(large.select("t")), similarity)
    met = twice(rare, "g").where((F.col("t") < F.col("u")) & (F.col("root") != F.col("v")) & _may_be_similar("n", "m", "p", "q", similarity) & ~F.arrays_overlap("before", "other"))
    met = met.select(F.col("t").alias("a"), F.col("u").alias("b"))
    rest = stored(near.unionByName(met).distinct().join(asked, ["a", "b"], "left_anti"))
    more = verified(rest)
    out = extended(known, more)
    discard(known, left, large, rare, rest, more)
    return out


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, t, class_id (least doc_id), class_rows and class_texts of every row of docs (doc_id, text)."""
    rows = stored(sketched(docs, similarity))
    items = one_each(rows)
    slim = stored(rows.select("doc_id", "t"))
    discard(rows)
    texts = docs.select(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = roots(items, texts, similarity)
    discard(items)
    # both sides of the last join are read from files: adaptive execution can then split a class that holds most rows
    named = stored(slim.join(found, slim.t == found.node, "left").select("doc_id", "t", F.coalesce("root", "t").alias("root")))
    by = named.groupBy("root", "t").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    return named.join(stored(by), "root").select("doc_id", "t", "root", "class_id", "class_rows", "class_texts")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class: the least doc_id's, nulls last; of repeated such rows the least text's.

    All other columns are kept, whatever their names.
    """
    found = stored(classes(docs, similarity))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t"))
    first = found.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("id"), F.col("o.t").alias("t"))
    copies = found.groupBy(F.col("doc_id").alias("id"), "t").agg(F.count(F.lit(1)).alias("n"))
    first = first.alias("f").join(copies.alias("c"), F.col("f.id").eqNullSafe(F.col("c.id")) & (F.col("f.t") == F.col("c.t"))).select("f.id", "f.t", "c.n")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("d"))
    kept = rows.join(first, (F.col("d") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return kept.where("n = 1").select("row.*").unionByName(kept.where("n > 1").dropDuplicates(["d", "id"]).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_rows", "class_texts")


ORACLE = None
