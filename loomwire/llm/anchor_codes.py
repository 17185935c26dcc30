"""Product quantisation with anchors-hierarchy metric trees (operator 11).

Vectors become integers, floor(scale * x), and are cut into equal parts; each part position has a codebook, which
rounds of exact integer k-means move. What makes a round cheap is a tree of balls over the parts at each position:

- Built from the middle out: about sqrt(n) anchors are chosen, each the point farthest from the owner of the widest
  ball, and take over the points that are nearer to them (a sorted list of distances tells where to stop looking).
  Upwards, the two balls whose union is smallest are joined until one is left; downwards, each anchor's points are a
  tree of their own. Every ball keeps its pivot, radius, and the count and sum of its points.
- In a round, a ball inherits its parent's list of candidate entries and drops those that own none of its points:
  entry j goes if another, i, is nearer to the whole ball, d(p,j)^2 - d(p,i)^2 > 2 R |i - j|. A ball with one candidate
  left is wholly owned, and gives its cached sum and count; only the points of leaf balls with several are looked at.

A task builds the trees of its own rows, in blocks of bounded size, and the trees are written once and used in every
round; a round gives one sum and count for each entry and task, so its shuffle and what the driver holds are a
codebook's size, whatever the number of rows. All rows are indexed and assigned exactly, ties to the lower entry.

Defined results: a vector that is null, or has null or non-finite components, takes no part. Vectors of other lengths
than the longest count as ended by zeros, and the longest as padded to a multiple of the parts. Rows without an id are
coded, and come last among the rows that start the codebooks; so are repeated rows, each by itself. With fewer rows
than entries the codebook has as many entries as rows. Rows whose label is null are one label. Components whose squared
distances could leave a long (about 2^19 at 64 components) are an error. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwire.llm._common import few, read
from loomwire.storage import discard, new_folder, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose trees are built together, points of a leaf ball, and blocks in one file (which bounds a read batch).
BLOCK, LEAF, BLOCKS_A_FILE = 4096, 24, 16


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, floor(scale * x) of every component, of the rows that take part."""
    x = F.transform("embedding", lambda x: x.cast("double") * scale)
    fine = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    near = F.transform(x, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x)).otherwise(F.lit((1 << 63) - 1)))
    return embeddings.where(F.col("embedding").isNotNull()).where(fine).select("vec_id", "label", near.alias("v"))


@dataclass
class Tree:
    """Balls of one position's points. Ball 0 is the root; a leaf's points are order[begin:end]."""

    points: np.ndarray  # distinct points, in the tree's order
    weights: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    total: np.ndarray
    left: np.ndarray
    right: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def anchors(points: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of at most `number` anchors, and for each point the place of the anchor that owns it."""
    n = len(points)
    chosen, owner = [0], np.zeros(n, np.int64)
    diff = points - points[0]
    dist = np.sqrt(np.einsum("ij,ij->i", diff, diff).astype(float))
    lists = [np.argsort(-dist, kind="stable")]  # an anchor's points, farthest first
    while len(chosen) < number:
        widest = max(range(len(chosen)), key=lambda a: dist[lists[a][0]] if len(lists[a]) else -1.0)
        new = int(lists[widest][0])
        if dist[new] == 0:
            break
        apart = np.sqrt(((points[chosen] - points[new]) ** 2).sum(axis=1).astype(float))
        place, gained = len(chosen), []
        for a in range(place):
            mine = lists[a]
            # points nearer to their owner than half the way to the new anchor stay, and so do all after them
            stop = np.searchsorted(-dist[mine], -apart[a] / 2, side="right")
            if not stop:
                continue
            near = mine[:stop]
            diff = points[near] - points[new]
            to = np.sqrt(np.einsum("ij,ij->i", diff, diff).astype(float))
            won = to < dist[near]
            if won.any():
                dist[near[won]], owner[near[won]] = to[won], place
                gained.append(near[won])
                lists[a] = np.concatenate([near[~won], mine[stop:]])
        mine = np.concatenate(gained)
        lists.append(mine[np.argsort(-dist[mine], kind="stable")])
        chosen.append(new)
    return np.array(chosen), owner


class _Builder:
    def __init__(self, points: np.ndarray, weights: np.ndarray, leaf: int) -> None:
        self.points, self.weights, self.leaf = points, weights, leaf
        self.order: list[np.ndarray] = []
        self.at = 0
        self.balls: list[tuple] = []  # pivot, radius, count, total, left, right, begin, end

    def _ball(self, members: np.ndarray, left: int, right: int, begin: int, pivot: np.ndarray | None = None) -> int:
        """A ball over members (indexes of points): its pivot is the member nearest to their mean, unless given."""
        p, w = self.points[members], self.weights[members]
        if pivot is None:
            d = p - p.mean(axis=0)
            pivot = p[np.einsum("ij,ij->i", d, d).argmin()]
        d = p - pivot
        radius = np.sqrt(float(np.einsum("ij,ij->i", d, d).max()))
        self.balls.append((pivot, radius, int(w.sum()), (p * w[:, None]).sum(axis=0), left, right, begin, begin + len(members)))
        return len(self.balls) - 1

    def grow(self, members: np.ndarray) -> tuple[int, np.ndarray]:
        """The ball over members, and their order below it."""
        begin = self.at
        if len(members) > self.leaf:
            chosen, owner = anchors(self.points[members], max(2, int(np.sqrt(len(members)))))
            if len(chosen) > 1:
                return self._middle_out(members, len(chosen), owner)
        self.at += len(members)
        self.order.append(members)
        return self._ball(members, -1, -1, begin), members

    def _middle_out(self, members: np.ndarray, k: int, owner: np.ndarray) -> tuple[int, np.ndarray]:
        groups = [members[owner == a] for a in range(k)]
        means, sizes = np.array([self.points[g].mean(axis=0) for g in groups]), [len(g) for g in groups]
        wide = np.array([np.sqrt((((self.points[g] - m) ** 2).sum(axis=1)).max()) for g, m in zip(groups, means, strict=True)])
        node, kids = list(range(k)), {}  # the union that each live place holds, and the two below each union
        reach = np.full((k, k), np.inf)
        for i in range(k):
            reach[i, :i] = (np.sqrt(((means[:i] - means[i]) ** 2).sum(axis=1)) + wide[:i] + wide[i]) / 2
        live = np.ones(k, bool)
        for union in range(k, 2 * k - 1):
            i, j = np.unravel_index(reach.argmin(), reach.shape)
            far = np.sqrt(((means[i] - means[j]) ** 2).sum())
            share = sizes[i] / (sizes[i] + sizes[j])
            wide[j] = max(wide[i] + far * (1 - share), wide[j] + far * share)
            means[j], sizes[j] = means[i] * share + means[j] * (1 - share), sizes[i] + sizes[j]
            kids[union], node[j], live[i] = (node[i], node[j]), union, False
            reach[i, :], reach[:, i] = np.inf, np.inf
            new = np.where(live, (np.sqrt(((means - means[j]) ** 2).sum(axis=1)) + wide + wide[j]) / 2, np.inf)
            reach[j, :j], reach[j + 1 :, j] = new[:j], new[j + 1 :]
        # unions may be nested as deep as there are anchors, so they are walked with a stack
        done: dict[int, tuple[int, np.ndarray, int]] = {}
        stack = [(2 * k - 2, False)]
        while stack:
            at, ready = stack.pop()
            if at < k:
                begin = self.at
                done[at] = (*self.grow(groups[at]), begin)
            elif ready:
                (left, below, begin), (right, more, _) = (done.pop(x) for x in kids[at])
                both = np.concatenate([below, more])
                done[at] = (self._ball(both, left, right, begin), both, begin)
            else:
                stack += [(at, True), (kids[at][1], False), (kids[at][0], False)]
        return done[2 * k - 2][:2]


def tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree over points (integers, n x d), and for each point its place among the tree's distinct ones."""
    distinct, inverse, weights = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    b = _Builder(distinct, weights, leaf)
    root, order = b.grow(np.arange(len(distinct)))
    # the root comes last when it is made; turned round it is ball 0
    last = len(b.balls) - 1
    turned = lambda i: last - i if i >= 0 else -1
    balls = b.balls[::-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    t = Tree(
        distinct[order], weights[order], np.array([x[0] for x in balls]), np.array([x[1] for x in balls]), np.array([x[2] for x in balls]), np.array([x[3] for x in balls]),
        np.array([turned(x[4]) for x in balls]), np.array([turned(x[5]) for x in balls]), np.array([x[6] for x in balls]), np.array([x[7] for x in balls]),
    )
    return t, place[inverse.ravel()]


def assign(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each of the tree's points its entry, each entry's sum and count, and how many points were looked at.

    All balls of one depth go down together, each with the candidates that its parent left.
    """
    between = np.sqrt(_squares(entries, entries).astype(float))
    owner = np.zeros(len(t.points), np.int64)
    total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    balls, candidates, looked = np.array([0]), np.ones((1, len(entries)), bool), 0
    while len(balls):
        square = _squares(t.pivot[balls], entries)
        masked = np.where(candidates, square, np.iinfo(np.int64).max)
        best = masked.argmin(axis=1)
        lead = square - square[np.arange(len(balls)), best][:, None]
        # the margin is far above rounding, and only keeps a candidate that could go
        gone = lead > (2 * t.radius[balls][:, None] * between[best]) * (1 + 1e-9) + 1e-6
        # in a ball of one point, distances decide, and the lower of equal entries is the first minimum
        gone |= (t.radius[balls] == 0)[:, None]
        gone[np.arange(len(balls)), best] = False
        candidates = candidates & ~gone
        alone = candidates.sum(axis=1) == 1
        for ball, e in zip(balls[alone], best[alone], strict=True):
            owner[t.begin[ball] : t.end[ball]] = e
        np.add.at(total, best[alone], t.total[balls[alone]])
        np.add.at(count, best[alone], t.count[balls[alone]])
        leaf = ~alone & (t.left[balls] < 0)
        for ball, open_ in zip(balls[leaf], candidates[leaf], strict=True):
            at, which = slice(t.begin[ball], t.end[ball]), np.flatnonzero(open_)
            mine = which[_squares(t.points[at], entries[which]).argmin(axis=1)]
            owner[at] = mine
            np.add.at(total, mine, t.points[at] * t.weights[at][:, None])
            np.add.at(count, mine, t.weights[at])
            looked += len(mine)
        inner = ~alone & (t.left[balls] >= 0)
        candidates = np.concatenate([candidates[inner], candidates[inner]])
        balls = np.concatenate([t.left[balls[inner]], t.right[balls[inner]]])
    return owner, total, count, looked


_FIELDS = ("points", "weights", "pivot", "radius", "count", "total", "left", "right", "begin", "end")
#: How a tree is written: points and pivots as 32-bit integers, sums and counts as 64-bit ones.
_KINDS = ("<i4", "<i4", "<i4", "<f8", "<i8", "<i8", "<i4", "<i4", "<i4", "<i4")


def trees(rows: DataFrame, width: int, parts: int, block: int = BLOCK) -> DataFrame:
    """One row for each block of rows (vec_id, label, v): their ids, and the trees of all positions."""
    kinds = {"ids": T.ArrayType(T.LongType()), "labels": T.ArrayType(rows.schema["label"].dataType), "places": T.BinaryType(), "sizes": T.ArrayType(T.IntegerType()), "balls": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField(k, t) for k, t in (kinds | dict.fromkeys(_FIELDS, T.BinaryType())).items()])

    def made(ids: pa.Array, labels: pa.Array, m: np.ndarray) -> pa.RecordBatch:
        cut = m.reshape(len(m), parts, width // parts)
        found = [tree(cut[:, p]) for p in range(parts)]
        joined = {f: b"".join(np.ascontiguousarray(getattr(t, f)).astype(k).tobytes() for t, _ in found) for f, k in zip(_FIELDS, _KINDS, strict=True)}
        places = b"".join(place.astype("<i4").tobytes() for _, place in found)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [one(ids), one(labels), pa.array([places]), pa.array([[len(t.points) for t, _ in found]], pa.list_(pa.int32())), pa.array([[len(t.radius) for t, _ in found]], pa.list_(pa.int32())), *[pa.array([joined[f]]) for f in _FIELDS]],
            schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, parts_, n = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                m = np.zeros((piece.num_rows, width), np.int64)
                vectors = piece.column(2)
                sizes = np.diff(vectors.offsets.to_numpy())
                m[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
                ids.append(piece.column(0)), labels.append(piece.column(1)), parts_.append(m)
                n += piece.num_rows
                while n >= block:
                    i, l, m = pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(parts_)
                    yield made(i[:block], l[:block], m[:block])
                    ids, labels, parts_, n = [i[block:]], [l[block:]], [m[block:]], n - block
        if n:
            yield made(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(parts_))

    return rows.select(F.col("vec_id").cast("long"), "label", "v").mapInArrow(run, schema)


def _read_trees(batch: pa.RecordBatch, i: int, dims: int) -> Iterator[Tree]:
    sizes, balls = batch.column("sizes")[i].as_py(), batch.column("balls")[i].as_py()
    flat = {f: np.frombuffer(batch.column(f)[i].as_py(), k) for f, k in zip(_FIELDS, _KINDS, strict=True)}
    point = ball = 0
    for n, b in zip(sizes, balls, strict=True):
        out = {}
        for f in _FIELDS:
            at, step = (point, n) if f in ("points", "weights") else (ball, b)
            x = flat[f][at * dims : (at + step) * dims].reshape(step, dims) if f in ("points", "pivot", "total") else flat[f][at : at + step]
            out[f] = x if f == "radius" else x.astype(np.int64)
        yield Tree(**out)
        point, ball = point + n, ball + b


def _round(found: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its points' mean, unused ones as they were."""
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, t in enumerate(_read_trees(batch, i, dims)):
                    _, s, c, _ = assign(t, books[p])
                    total[p] += s
                    count[p] += c
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "s"])

    used = found.drop("ids", "labels", "places").mapInArrow(run, "p int, e int, n long, s array<long>")
    # a sum over all rows may leave a long, so the sums meet as decimals
    wide = [F.sum(F.get("s", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    out = books.copy()
    for r in used.groupBy("p", "e").agg(F.sum("n").alias("n"), *wide).collect():  # parts x entries rows at most
        out[r["p"], r["e"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dims)]
    return out


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (bytes, an entry a part) and error of rows (vec_id, label, v), and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: at most 256 entries")
    longest, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.when(x < 0, -x).otherwise(x))))).first()
    width = max(1, -(-(longest or 0) // parts)) * parts
    if most is not None and 4 * width * (most + 1) ** 2 >= 1 << 62:
        raise ValueError(f"components as large as {most} have squared distances beyond a long")
    dims = width // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        books[i, : len(r["v"])] = r["v"]
    books = np.ascontiguousarray(books.reshape(len(first), parts, dims).transpose(1, 0, 2))
    spark = rows.sparkSession
    at = new_folder(spark)
    made = trees(rows, width, parts, block)
    made.write.option("maxRecordsPerFile", BLOCKS_A_FILE).parquet(at)
    found = spark.read.schema(made.schema).parquet(at)
    found.stored_at = at
    for _ in range(rounds if len(first) else 0):
        books = _round(found, books)
    final = books  # a name of its own for the closure
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                places = np.frombuffer(batch.column("places")[i].as_py(), "<i4").reshape(parts, len(ids))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, t in enumerate(_read_trees(batch, i, dims)):
                    owner = assign(t, final[p])[0]
                    d = t.points - final[p][owner]
                    error += np.einsum("ij,ij->i", d, d)[places[p]]
                    codes[:, p] = owner[places[p]]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["vec_id", "label", "codes", "error"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])
    out = stored(found.select("ids", "labels", "places", "sizes", "balls", *_FIELDS).mapInArrow(run, schema))
    discard(found)
    return out, final


def by_label(coded: DataFrame) -> DataFrame:
    """The coded rows with label_error, the error summed over equal labels. Nulls are one label.

    Labels' sums are made before the shuffle; few of them go out to the rows, more meet them in a join.
    """
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    many = stored(totals)
    return coded.join(F.broadcast(many) if few(many) else many, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(quantised(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))
    return by_label(coded).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    part = PARTS  # embeddings of 64 components: four a part
    ctes = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT rid, vec_id, label, i AS part, v[4 * i + 1 : 4 * i + 4] AS x FROM v, range({part}) t(i))",
        f"c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x AS c FROM p WHERE rid <= {ENTRIES})",
    ]
    d = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))
    for r in range(ROUNDS + 1):
        # a distance and an entry in one number: the least has the lowest entry of the nearest
        ctes.append(f"a{r} AS MATERIALIZED (SELECT rid, p.part, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, min(({d}) * 64 + e) AS best FROM p JOIN c{r} ON p.part = c{r}.part GROUP BY rid, p.part)")
        if r < ROUNDS:
            mean = ", ".join(f"floor(sum(x[{i}]) / count(*))::BIGINT" for i in range(1, 5))
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT part, best % 64 AS e, [{mean}] AS c FROM a{r} GROUP BY ALL) m ON c.part = m.part AND c.e = m.e)")
    ctes.append(f"b AS (SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, e) AS s FROM c{ROUNDS})")
    ctes.append(f"k AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', (best % 64)::INT), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256(b.s) AS codebooks_sha256 FROM k, b"


ORACLE = _oracle()
