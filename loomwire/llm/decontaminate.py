"""Benchmark decontamination with a generalised suffix automaton (operator 5).

The items' words become one suffix automaton; a document's words stream through it, and after each word the longest
suffix that some item contains is known. Ten matched words mean that an item's window of ten occurs there; items of
fewer words count as a whole, found by the marks on the automaton's states.

Items are cut into blocks of at most `BLOCK_WORDS` words (an item longer than a block is cut with nine words' overlap,
so no window is lost). A block's automaton is all that is ever broadcast, which bounds it; each further block is one
more pass over the documents, in place, without a shuffle or a join.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. Defined results: a null or empty text has
no words and is clean; items without words are ignored; repeated items count each by its id, a null item_id never
counts; repeated documents are judged each; an empty benchmark leaves all clean; further columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwire.llm._common import read

WINDOW = 10
BLOCK_WORDS = 40_000
_KEPT = {*range(48, 58), *range(97, 123), *range(128, 256)}
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32) for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split()


class Automaton:
    """A generalised suffix automaton over word ids, with the items of each state's window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        at: list[tuple[int, int]] = []
        shorts: list[tuple[int, int | None, int]] = []
        for item, ws in items:
            last = 0
            for w in ws:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                at.append((last, item))
            if 0 < len(ws) < window:
                shorts.append((last, item, len(ws)))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        owners: list[set] = [set() for _ in self.length]
        for s, item in at:
            owners[s].add(item)
        for s in order:
            if self.length[s] >= window and self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        #: For each state: the items with the window that ends here, and whole short items as (words, item).
        self.full: list[frozenset] = [frozenset()] * len(self.length)
        self.short: list[list[tuple[int, int | None]]] = [[] for _ in self.length]
        for s, item, n in shorts:
            self.short[s].append((n, item))
        for s in reversed(order):
            up = self.link[s]
            self.full[s] = frozenset(owners[s]) if self.length[s] >= window > self.length[up] else self.full[up]
            if up > 0:
                self.short[s] = self.short[s] + self.short[up]
        self.least = min([n for _, _, n in shorts], default=window)

    def _clone(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        return len(self.length) - 1

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            cur = None
        else:
            cur = len(length)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
        p = last
        if cur is not None:
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p == -1:
                return cur
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
        clone = self._clone(q, length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        if cur is None:
            return clone
        link[cur] = clone
        return cur

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit ranges [start, end) in words, joined where they touch, and the items that occur."""
        ids = list(map(self.ids.get, ws))
        spans: list[tuple[int, int]] = []
        found: set = set()
        # a word that no item has resets the automaton: only runs between such words are streamed
        outside = np.flatnonzero(np.fromiter((x is None for x in ids), bool, len(ids)))
        edges = np.concatenate([[-1], outside, [len(ids)]])
        for k in np.flatnonzero(np.diff(edges) > self.least):
            self._stream(ids, int(edges[k]) + 1, int(edges[k + 1]), spans, found)
        return joined(spans), found

    def _stream(self, ids: list[int], start: int, end: int, spans: list, found: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = n = 0
        for i in range(start, end):
            w = ids[i]
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, n = to, n + 1
            if n >= window:
                spans.append((i + 1 - window, i + 1))
                found |= self.full[state]
            for size, item in self.short[state]:
                if size <= n:
                    spans.append((i + 1 - size, i + 1))
                    found.add(item)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items' words in blocks of bounded size; one item at a time comes to the driver."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ws = words(row[1] or "")
        step = max(1, block_words - window + 1)
        for part in [ws[i : i + block_words] for i in range(0, max(1, len(ws) - window + 1), step)] if len(ws) > block_words else [ws]:
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            if part:
                block.append((row[0], part))
                size += len(part)
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` (with text) plus n_words, hits (word ranges) and hit_items."""
    extra = [T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("hit_items", T.ArrayType(T.LongType()))]
    names = [f.name for f in extra]
    out = docs.drop(*names).select("*", F.lit(None).cast("long").alias(names[0]), F.array().cast(HITS).alias(names[1]), F.array().cast("array<long>").alias(names[2]))
    sc = docs.sparkSession.sparkContext
    for block in [*item_blocks(items, window, block_words)] or [[]]:
        sent = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(sent.value, window)
            for batch in batches:
                n, hits, found = [], [], []
                for text, old, old_items in zip(batch.column("text"), batch.column(names[1]), batch.column(names[2]), strict=True):
                    ws = words(text.as_py() or "")
                    spans, items_ = automaton.scan(ws)
                    n.append(len(ws))
                    hits.append([{"start": a, "end": b} for a, b in joined([*spans, *((x["start"], x["end"]) for x in old.as_py())])])
                    found.append(sorted({*old_items.as_py(), *(x for x in items_ if x is not None)}))
                arrays = {names[0]: pa.array(n, pa.int64()), names[1]: pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), names[2]: pa.array(found, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([arrays.get(k, batch.column(i)) for i, k in enumerate(batch.schema.names)], batch.schema.names)

        out = out.mapInArrow(run, T.StructType([*docs.drop(*names).schema.fields, *extra]))
    return out


def remove(found: DataFrame, most: float = 0.5) -> DataFrame:
    """Texts without their hit ranges; documents of which more than `most` of the words are hit go altogether.

    A column expression, so that no task needs a second Python worker beside that of `find`.
    """
    # gaps and words in turn: word i is between gap i and gap i + 1; what stays are the stretches from a gap to a gap
    gaps, found_words = F.split("text", _WORD.pattern, -1), F.regexp_extract_all("text", F.lit(_WORD.pattern), F.lit(0))
    parts = F.flatten(F.zip_with(gaps, found_words, lambda g, w: F.array(g, F.coalesce(w, F.lit("")))))

    def left(all_: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(0)), F.col("hits.end")), F.concat(F.col("hits.start"), F.array(F.floor(F.size(all_) / 2).cast("int") - 1))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(all_, 2 * a + 1, 2 * (b - a) + 1), "")), "")

    cut = F.get(F.transform(F.array(parts), left), F.lit(0))
    share = F.aggregate("hits", F.lit(0), lambda a, h: a + h["end"] - h["start"]) / F.greatest(F.col("n_words"), F.lit(1))
    kept = found.where(share <= most).withColumn("text", F.when(F.size("hits") > 0, cut).otherwise(F.col("text")))
    return kept.drop("n_words", "hit_items", "hits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    ids = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM low, sizes WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT rid, grams.n, i, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT rid, n, i FROM hit)) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""
