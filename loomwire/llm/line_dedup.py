"""Line dedup by a segment-partition edit join (operator 2).

Two different lines are near equal if they are at most `allowed` edits apart: one for each `A_EDIT` characters of the
longer one, `EDITS` at most. Near-equal lines share, by the pigeonhole principle, one of edits + 1 segments almost in
place. A line indexes its segments under its length; a line probes the indexes of its own and the few shorter lengths
with the substrings that the multi-match-aware rule allows (Li et al., 2011). Index and probes meet in one equi-join on
(edits, length, segment number, substring), whose condition also compares counts of letters, a lower bound of the
distance, so that crowded keys emit few candidates. Candidates are verified by banded bit-parallel edit distance, and
connected components are the classes.

Lines are trimmed. Equal lines are one node; lines of fewer than `A_EDIT` characters are allowed no edit. Each task
indexes a line once, so a line that a third of the documents hold adds a row a task.

Defined results: null texts have no lines and empty lines none; repeated documents hold their lines each; null doc_ids
are kept, and name a class only if all are null; an empty table gives no rows; other columns are ignored by the query
and kept by `remove_repeats`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm._common import only, read
from loomwire.llm.banded import within
from loomwire.operators.graph import components
from loomwire.storage import discard, stored

EDITS, A_EDIT = 2, 20
#: Lines of at least so many characters are removed where they repeat; shorter ones may be headings.
LEAST = 40
#: A document with a smaller share of its characters left after removal goes.
LEFT = 0.2
#: Distinct lines whose index rows a task remembers; beyond it a line may be indexed again, to no effect.
REMEMBERED = 500_000
#: Kinds of letters that are counted, each modulo 8 in three bits.
LETTERS = 21
_KINDS = bytes(b % LETTERS for b in range(256))


def allowed(length: int, edits: int = EDITS) -> int:
    """Edits between a line of `length` characters and one that is no longer."""
    return min(edits, length // A_EDIT)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of a line's edits + 1 segments, the longer ones last."""
    parts = edits + 1
    base, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int, least: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, length) of the substrings that a line of `length` looks up."""
    out = []
    for shorter in range(max(least, length - edits), length + 1):
        gap = length - shorter
        for i, (at, n) in enumerate(segments(shorter, edits)):
            low = max(0, at - i, at + gap - (edits - i))
            high = min(length - n, at + i, at + gap + (edits - i))
            out += [(shorter, i, p, n) for p in range(low, high + 1)]
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, k (a null doc_id's text), line_no (from 0), line, t (64-bit hash) and m (128-bit digest) of all non-empty trimmed lines."""
    key = F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("string")))
    rows = docs.select("doc_id", key.alias("k"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "k", "line_no", F.trim("line").alias("line")).where(F.col("line") != "")
    return rows.select("doc_id", "k", "line_no", "line", F.xxhash64("line").alias("t"), F.md5("line").alias("m"))


def plan(length: int, edits: int, probe: bool) -> list[tuple[int, int, int]]:
    """(seed, start, end) of the segments that a line of `length` indexes, or of the substrings that it looks up."""
    if probe:
        e = allowed(length, edits)
        found = [(e, n, i, p, k) for n, i, p, k in probes(length, e, 1)] if e else []
    else:
        longer = {e for n in range(length, length + edits + 1) if (e := allowed(n, edits)) and n - length <= e}
        found = [(e, length, i, p, k) for e in sorted(longer) for i, (p, k) in enumerate(segments(length, e))]
    return [(e << 48 | n << 8 | i, p, p + k) for e, n, i, p, k in found]


def indexed(lines: DataFrame, edits: int, probe: bool) -> DataFrame:
    """key, t and bag (counts of letters): the index rows, or the probing rows, of lines (t, line)."""
    names = ["key", "t", "bag"]
    shifts = np.arange(0, 3 * LETTERS, 3, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        plans: dict[int, list[tuple[int, int, int]]] = {}
        seen: set[int] = set()

        def rows(keys: list[int], ts: list[int], counts: list[int], letters: list[bytes]) -> pa.RecordBatch:
            at = np.repeat(np.arange(len(ts)) * LETTERS, [len(x) for x in letters])
            bags = np.bincount(at + np.frombuffer(b"".join(letters), np.uint8), minlength=len(ts) * LETTERS).reshape(-1, LETTERS).astype(np.uint64)
            bags &= np.uint64(7)
            bags = ((bags ^ bags >> np.uint64(1)) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ts, np.int64), counts)), pa.array(np.repeat(bags, counts))], names)

        for batch in batches:
            keys, ts, counts, letters, size = [], [], [], [], 0
            for t, line in zip(batch.column("t").to_pylist(), batch.column("line"), strict=True):
                if t in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(t)
                text = line.as_py()
                n = len(text)
                if (cuts := plans.get(n)) is None:
                    cuts = plans[n] = plan(n, edits, probe)
                if not cuts:
                    continue
                if text.isascii():
                    raw = text.encode()
                    keys += [digest(raw[p:q], seed) for seed, p, q in cuts]
                else:
                    raw = text.encode("utf-32-le", "replace")[::4]
                    keys += [digest(text[p:q].encode("utf-8", "replace"), seed) for seed, p, q in cuts]
                letters.append(raw.translate(_KINDS))
                ts.append(t)
                counts.append(len(cuts))
                size += n
                if size > 2_000_000:  # so many characters at a time, however long the lines
                    yield rows(keys, ts, counts, letters)
                    keys, ts, counts, letters, size = [], [], [], [], 0
            if ts:
                yield rows(keys, ts, counts, letters)

    return lines.select("t", "line").mapInArrow(run, "key long, t long, bag long")


def _apart(x: Column, y: Column) -> Column:
    """Differing bits of the counts, in Gray code: a letter more or less is one bit, so at most 2 for each edit."""
    return F.bit_count(x.bitwiseXOR(y))


def candidates(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs a < b of line hashes that share a segment; lines has t and line."""
    index = indexed(lines, edits, False).select("key", F.col("t").alias("b"), F.col("bag").alias("_y"))
    probe = indexed(lines, edits, True).select("key", F.col("t").alias("a"), F.col("bag").alias("_x"))
    both = probe.join(index, "key").where((F.col("a") != F.col("b")) & (_apart(F.col("_x"), F.col("_y")) <= 2 * edits))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Verified edges a < b between the digests of different lines that are near equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True)
            keep = [within(x, y, allowed(max(len(x), len(y)), edits)) is not None for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(candidates(lines, edits))
    used = stored(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    texts = stored(only(lines.select("t", "m", "line"), "t", used).dropDuplicates(["t", "m"]))
    own = texts.select(F.col("t").alias("a"), F.col("m").alias("_m"), F.col("line").alias("_x"))
    other = texts.select(F.col("t").alias("b"), F.col("m").alias("_n"), F.col("line").alias("_y"))
    both = pairs.join(own, "a").join(other, "b").select(F.least("_m", "_n").alias("a"), F.greatest("_m", "_n").alias("b"), "_x", "_y")
    out = stored(both.mapInArrow(run, "a string, b string").distinct())
    discard(pairs, used, texts)
    return out


def classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, k, line_no, m (digest), class_doc, class_line (the class's first line), class_rows, n_links and long of every line."""
    lines = lines_of(docs)
    edges = links(lines, edits)
    roots = components(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    named = stored(ends.groupBy("node").agg(F.count(F.lit(1)).alias("links")).join(roots, "node"))
    discard(edges, roots)
    slim = lines.select("doc_id", "k", "line_no", "m", (F.char_length("line") >= least).alias("long"))
    rows = slim.join(named, slim.m == named.node, "left").select("doc_id", "k", "line_no", "m", F.coalesce("root", "m").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links"), "long")
    # both sides of the last join are read from files: adaptive execution can then split a class that holds most lines
    rows = stored(rows)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("line_no")))
    by = rows.groupBy("root").agg(first.alias("_f"), F.count(F.lit(1)).alias("class_rows"))
    by = stored(by.select("root", F.col("_f.doc_id").alias("class_doc"), F.col("_f.line_no").alias("class_line"), "class_rows"))
    return rows.join(by, "root").select("doc_id", "k", "line_no", "m", "class_doc", "class_line", "class_rows", "n_links", "long")


def remove_repeats(docs: DataFrame, edits: int = EDITS, least: int = LEAST, left: float = LEFT) -> DataFrame:
    """`docs` without the long lines whose class has an earlier line.

    A document of which that leaves nothing but white space, or less than `left` of its characters, was a copy and goes;
    all others stay. With `left` 0 every line that isn't repeated stays. A document without an id is told by its text.
    """
    found = classes(docs.select("doc_id", "text"), edits, least)
    repeat = F.col("long") & ~(F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line")))
    gone = found.where(repeat).groupBy(F.col("doc_id").alias("id"), "k").agg(F.collect_set(F.concat_ws(":", "line_no", "m")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("string"))).alias("own"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("own").eqNullSafe(F.col("k")), "left")
    joined = joined.withColumn("lines", F.split("text", "\n"))
    names = F.array_except(F.transform("lines", lambda x, i: F.concat_ws(":", i, F.md5(F.trim(x)))), "gone")
    kept = F.transform(names, lambda x: F.get("lines", F.substring_index(x, ":", 1).cast("int")))
    out = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")))
    some = F.col("kept").rlike(r"\S")
    out = out.where(F.col("kept").isNull() | some & (F.char_length(F.trim(F.replace("kept", F.lit("\n"), F.lit("")))) >= left * F.char_length("text")))
    return out.select(F.col("row").withField("text", F.coalesce("kept", "text")).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("k", "m", "long")


ORACLE = None
