"""Near duplicates over a stream, with state that ends after the horizon.

Each article goes to its signature's bands. A band keeps the articles that were new in it; an arrival that agrees with one
of the last days is a duplicate and isn't kept, so a story that everybody copies stays one entry, and so does its state.
Bands are dealt into shards, and state is kept a shard: it is read and added to once a micro-batch, not once a band. Timers
of event time take entries out once the watermark is past their horizon.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwire.operators import dedup
from loomwire.params import DEFAULTS, Params

OUT = "article_id long, duplicate_of long, similarity double"
_ENTRY = "band long, article_id long, us long, sig binary"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state; a shard's entries are held at once. Timers are set at multiples of so many milliseconds.
SHARDS, STEP_MS = 1024, 6 * 3_600_000


class Shard(StatefulProcessor):
    """The articles of some bands of the last `days`."""

    def __init__(self, days: int, jaccard: float) -> None:
        self.horizon, self.jaccard = days * 86_400_000_000, jaccard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", _ENTRY)

    def _due(self, us: int) -> int:
        """When an entry of that instant may go, in milliseconds: after its horizon."""
        return -(-((us + self.horizon) // 1000 + 1) // STEP_MS) * STEP_MS

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        kept = defaultdict(list)
        if self.entries.exists():
            for band, i, us, sig in self.entries.get():
                kept[band].append((i, us, *_halves(bytes(sig))))
        new, out = [], []
        for us, i, band, sig in sorted(r for part in rows for r in zip(*(part[c].tolist() for c in ("us", "article_id", "band", "sig")), strict=True)):
            low, high = _halves(sig)
            known = kept[band]
            near = [(-float(((low == x) & (high == y)).mean()), j) for j, t, x, y in known if 0 <= us - t <= self.horizon and j != i]
            near = min((n for n in near if -n[0] >= self.jaccard), default=None)
            if near:
                out.append((i, near[1], -near[0]))
            elif all(j != i for j, *_ in known):
                known.append((i, us, low, high))
                new.append((band, i, us, sig))
        if new:
            self.entries.appendList(new)
        for due in {self._due(us) for _, _, us, _ in new}:
            self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=["article_id", "duplicate_of", "similarity"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        kept = [x for x in self.entries.get() if self._due(x[2]) > due] if self.entries.exists() else []
        if kept:
            self.entries.put(kept)
        else:
            self.entries.clear()
        yield pd.DataFrame({"article_id": [], "duplicate_of": [], "similarity": []})

    def close(self) -> None:
        pass


def _halves(sig: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A signature's values and distances, from `_short`."""
    n = len(sig) // 5
    return np.frombuffer(sig, np.uint32, n), np.frombuffer(sig, np.uint8, n, 4 * n)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures as bytes: each value's lower 32 bits, then what is above, a borrowed bin's distance, which is below 256."""
    for batch in batches:
        if batch.num_rows:
            v = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1)
            both = np.hstack([(v & 0xFFFFFFFF).astype(np.uint32).view(np.uint8).reshape(len(v), -1), (v >> 32).astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in both], pa.binary())], [*batch.schema.names[:-1], "sig"])


def near_duplicates(spark: SparkSession, rows: DataFrame, late: str = "1 hour", params: Params = DEFAULTS) -> DataFrame:
    """article_id, duplicate_of and similarity, once for each band where an article (article_id, text, at) meets an earlier one.

    Two articles are near if their signatures agree, not more than the horizon apart; articles later than `late` behind
    the stream are not looked at. The session's state store is set to one that such state needs.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    width = params.permutations // dedup.BANDS
    sigs = dedup.signatures(rows.select(F.struct("article_id", "at").alias("doc_id"), "text"), params, "struct<article_id: bigint, at: timestamp>")
    hashes = F.transform(F.sequence(F.lit(0), F.lit(dedup.BANDS - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * width + 1, F.lit(width))))
    short = sigs.select("doc_id.article_id", "doc_id.at", hashes.alias("bands"), "sig").mapInArrow(_short, "article_id long, at timestamp, bands array<long>, sig binary")
    bands = short.select("article_id", "at", F.unix_micros("at").alias("us"), "sig", F.explode("bands").alias("band")).withColumn("shard", F.pmod("band", F.lit(SHARDS))).withWatermark("at", late)
    return bands.groupBy("shard").transformWithStateInPandas(Shard(params.dedup_days, params.jaccard), OUT, "Append", "EventTime")
