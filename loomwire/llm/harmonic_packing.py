"""Harmonic packing of token sequences (operator 3).

Lengths fall into reciprocal-capacity classes: class k holds pieces of at most C/k tokens, and each of its bins takes
exactly k of them. Classes need no look at each other and workers none at each other, so packing is one pass without a
shuffle: each task fills its own bins, at most one open bin a class, and its open bins' pieces are joined and cut at
the end, which leaves one short sequence a task. A document is cut only where its class would waste more than `waste`
tokens a bin: then a piece of C/(k+1) goes to class k+1, whose bins it fills, and the rest is classed anew.

Token ids are those of a `tokenizers` byte-level BPE file, plus an end id.

Defined results: a null or empty text is the end id alone; very long texts are many full pieces; repeated rows are
packed each; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomwire.llm._common import read

CAPACITY, END_ID, WASTE = 2048, 1, 48
#: The byte-level pre-tokenizer's pattern, but for white space.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
_RUN = re.compile(r"\s\s")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids as little-endian 32-bit bytes: the ids of a `tokenizers` byte-level BPE file.

    The merges run in tiktoken, which is several times faster on one core, over ranks taken from the same file (an id
    is its merge's rank there). A text with the file's special strings goes to `tokenizers` itself, which is only kept
    in memory once there is one.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.path, tokenizer = path, Tokenizer.from_file(path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        byte = {chr(c): b for b, c in _byte_characters()}
        ranks = {bytes(byte[c] for c in w): i for w, i in tokenizer.get_vocab(with_added_tokens=False).items() if w not in self.special}
        made = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spaced, self.plain = made("spaced", rf"{_WORDS}|\s+(?!\S)|\s+"), made("plain", rf"{_WORDS}|\s+")

    @cached_property
    def tokenizer(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # the look-ahead matters only before a run of white space, and costs a third of the time
        return np.asarray((self.spaced if _RUN.search(text) else self.plain).encode_ordinary(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _byte_characters() -> list[tuple[int, int]]:
    """Byte-level BPE writes a byte as a printable character: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [(b, b) for b in sorted(shown)] + [(b, 256 + i) for i, b in enumerate(hidden)]


def cuts(length: int, capacity: int = CAPACITY, waste: int = WASTE) -> list[tuple[int, int]]:
    """Pieces of a document as (tokens, class)."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= waste:
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        rest -= piece
    return out


class Packer:
    """One worker's bins. `place` and `close` give (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, waste: int = WASTE) -> None:
        self.capacity, self.waste, self.sequence = capacity, waste, 0
        self.open: dict[int, list[tuple]] = {}

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, length in pieces:
            yield doc, start, length, self.sequence, offset
            offset += length
        self.sequence += 1

    def place(self, doc: object, length: int) -> Iterator[tuple]:
        start = 0
        for piece, k in cuts(length, self.capacity, self.waste):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, piece))
            start += piece
            if len(bin_) == k:
                yield from self._emit(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        """What is left in open bins, joined and cut at the capacity."""
        now, room = [], self.capacity
        for doc, start, length in (p for k in sorted(self.open) for p in self.open[k]):
            while length:
                take = min(room, length)
                now.append((doc, start, take))
                start, length, room = start + take, length - take, room - take
                if not room:
                    yield from self._emit(now)
                    now, room = [], self.capacity
        if now:
            yield from self._emit(now)
        self.open = {}


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, waste: int = WASTE, ids: bool = True, rows: int = 4096) -> DataFrame:
    """Pieces of `docs` (doc_id, text) with their place; `ids` adds the tokens themselves."""
    schema = PIECES if ids else T.StructType(PIECES.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, tail = _encoder(tokenizer), Packer(capacity, waste), np.asarray([end_id], "<u4").tobytes()
        # sequence ids: the task's partition in the upper bits, so that workers need not agree
        base = TaskContext.get().partitionId() << 40

        def placed() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    tokens = encode(text.as_py() or "") + tail
                    yield from packer.place((doc_id, tokens), len(tokens) // 4)
            yield from packer.close()

        out = placed()
        while chunk := list(islice(out, rows)):
            parts = [d[1][4 * s : 4 * (s + n)] for d, s, n, _, _ in chunk]
            columns = [
                pa.array([d[0] for d, *_ in chunk], pa.int64()), pa.array([c[1] for c in chunk], pa.int64()), pa.array([c[2] for c in chunk], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array([len(d[1]) // 4 for d, *_ in chunk], pa.int64()), pa.array([base + c[3] for c in chunk], pa.int64()), pa.array([c[4] for c in chunk], pa.int64()),
            ]
            if ids:
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), ids=False)


ORACLE = None
