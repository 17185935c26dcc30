"""Byte-pair encoding by dynamic programming over prefixes, and decoding (operator 13).

Each prefix of a word has one encoding, so it has one last token; and that encoding without it is the encoding of the
shorter prefix. A last token is therefore found without merging: it is a token that ends here, whose start is a prefix
with a known last token, and that pair must be compatible, which means that no merge across their border would have
come before the merges that made the two. A table holds the last token of every prefix, and following it back from the
whole word gives the ids.

Tokens that end at a byte come from a suffix automaton over the vocabulary: its state after a prefix stands for the
longest suffix that some token contains, and the tokens among that state's suffixes hang on its chain of links. Words
are the pre-tokenizer's; a word's ids are remembered, in two generations of bounded size.

Only byte-level files with one merge a token are read; what a file asks for beyond that (a normalizer, dropout, a
prefix space) is an error, not a different result.

Defined results: a null or empty text has no ids; very long texts and words take time linear in their length (times the
longest token's); repeated rows are encoded each; null doc_ids are kept; strings of special tokens become their ids,
as in the library; unpaired surrogates become `?`; an empty table gives no rows; other columns are ignored. Decoding
takes null as no ids, skips nothing, and ids outside the vocabulary are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm._common import read

#: Words remembered by one worker, in each of two generations (a text adds SLICE words between two looks at the count);
#: longer words than LONGEST bytes are encoded anew.
REMEMBERED, LONGEST, SLICE = 200_000, 64, 50_000
#: Rows, and characters or so, in one output batch.
ROWS, CHARS = 512, 4_000_000
#: The byte-level pre-tokenizer's pattern.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _characters() -> dict[str, int]:
    """The printable character that stands for each byte in the file: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SuffixAutomaton:
    """The substrings of some byte strings; `ends` lists the strings that are suffixes of what was read.

    Strings may be added in any order. After `close`, state s has transitions go[s << 8 | byte], the longest substring's
    length, a link to its longest proper suffix in another state, and in `ends` the marked strings among its suffixes, as
    (length, mark) by falling length.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.marks: dict[int, list[tuple[int, int]]] = {}

    def add(self, string: bytes, mark: int) -> None:
        state = 0
        for byte in string:
            state = self._step(state, byte)
        self.marks.setdefault(state, []).append((len(string), mark))

    def _split(self, p: int, byte: int) -> int:
        """The state of p's longest substring and `byte`, made apart from the longer ones that it was kept with."""
        q = self.next[p][byte]
        if self.length[q] == self.length[p] + 1:
            return q
        new = len(self.length)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        # of q's marked strings the shorter ones go along
        if q in self.marks:
            self.marks[new] = [m for m in self.marks[q] if m[0] <= self.length[new]]
            self.marks[q] = [m for m in self.marks[q] if m[0] > self.length[new]]
        while p >= 0 and self.next[p].get(byte) == q:
            self.next[p][byte] = new
            p = self.link[p]
        return new

    def _step(self, last: int, byte: int) -> int:
        if byte in self.next[last]:
            return self._split(last, byte)
        new, p = len(self.length), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and byte not in self.next[p]:
            self.next[p][byte] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, byte)
        return new

    def close(self) -> None:
        self.go = {s << 8 | b: t for s, by in enumerate(self.next) for b, t in by.items()}
        self.next = []
        self.ends: list[tuple] = [()] * len(self.length)
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            above = self.ends[self.link[s]] if s else ()
            self.ends[s] = (*sorted(self.marks[s], reverse=True), *above) if s in self.marks else above
        self.marks = {}


class Encoder:
    """Texts to ids of a byte-level BPE file, and back."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE file: {path} {odd}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"special tokens that take in their surroundings aren't supported: {path}")
        byte = _characters()
        as_bytes = lambda s: bytes(byte[c] for c in s)
        special = {t["content"]: t["id"] for t in added}
        ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in special}
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        if -1 in self.single:
            raise ValueError(f"the vocabulary lacks single bytes: {path}")
        #: The rank at which a pair of ids merges, and for each id the rank and the halves of its own merge.
        self.rank: dict[int, int] = {}
        n = 1 + max([*ids.values(), *special.values()])
        self.made, self.first, self.second = [-1] * n, [-1] * n, [-1] * n
        for r, pair in enumerate(model["merges"]):
            a, b = (as_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[a + b]
            if self.made[whole] >= 0:
                raise ValueError(f"two merges make one token: {path}")
            self.rank[ids[a] << 32 | ids[b]] = r
            self.made[whole], self.first[whole], self.second[whole] = r, ids[a], ids[b]
        self.pairs: dict[int, bool] = {}
        self.automaton = SuffixAutomaton()
        for s, i in ids.items():
            # a token whose halves aren't compatible never comes out of merging
            if len(s) == 1 or (self.made[i] >= 0 and self._reached(i)):
                self.automaton.add(s, i)
        self.automaton.close()
        self.find = regex.compile(_WORD).findall
        self.special = special
        self.apart = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        strings = {i: s for s, i in ids.items()} | {i: s.encode() for s, i in special.items()}
        table = [strings.get(i, b"") for i in range(n)]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(s) for s in table])]).astype(np.int64)

    def _reached(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in it: its halves are, and nothing else comes first between them."""
        return self._compatible(self.first[token], self.second[token], self.made[token])

    def _compatible(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether the two stay side by side until `limit`: no merge over their border comes before their own merges.

        Time runs backwards: of the two parts at the border the one that was made last is taken apart. Between two such
        steps the parts stood side by side, so their merge, if there is one, must not have been due. Of equal ranks the
        one further left comes first.
        """
        rank, made, first, second = self.rank, self.made, self.first, self.second
        while True:
            due = rank.get(left << 32 | right)
            if due is not None and due < limit:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, second[left]
            else:
                limit, right = b + 1, first[right]

    def word(self, data: bytes) -> list[int]:
        """Ids of one word."""
        auto = self.automaton
        go, link, length, ends = auto.go, auto.link, auto.length, auto.ends
        pairs, compatible = self.pairs, self._compatible
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        state = n = 0
        for at, byte in enumerate(data, 1):
            while (to := go.get(state << 8 | byte)) is None:
                state = link[state]  # the root has every byte
                n = length[state]
            state, n = to, n + 1
            for k, token in ends[state]:
                if k > n:
                    continue
                before = last[at - k]
                if before >= 0:
                    key = before << 32 | token
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) > 2_000_000:
                            pairs.clear()
                        good = pairs[key] = compatible(before, token)
                    if not good:
                        continue
                last[at], size[at] = token, k
                break
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _packed(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            data = word.encode("utf-8", "replace")
            found = np.array(self.word(data), "<i4").tobytes()
            if len(data) > LONGEST:
                return found
        self.young[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        words, out = self.find(text), []
        for i in range(0, len(words), SLICE):
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            get, packed = self.young.get, self._packed
            out += [get(w) or packed(w) for w in words[i : i + SLICE]]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not self.apart or not self.apart.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m.group()]], "<i4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.ends) - 1)]
        starts, sizes = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        place = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(ids) else starts, sizes) + np.arange(sizes.sum())
        return self.bytes[place].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One a worker, whose size is the vocabulary's."""
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of docs (doc_id, text), where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)

        def batch_of(doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("i4")
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))], ["doc_id", "ids"])

        for batch in batches:
            doc_ids, parts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                parts.append(encoder.encode(text.as_py() or ""))
                size += len(parts[-1])
                if len(parts) >= ROWS or size >= CHARS:
                    yield batch_of(doc_ids, parts)
                    doc_ids, parts, size = [], [], 0
            if parts:
                yield batch_of(doc_ids, parts)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and text of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # in slices, so that no batch of texts is much larger than CHARS
                texts, size, start = [], 0, at
                while at < batch.num_rows and len(texts) < ROWS and size < CHARS:
                    ids = batch.column(1)[at].values
                    texts.append(encoder.decode(ids.to_numpy(zero_copy_only=False).astype(np.int64) if ids is not None and not ids.null_count else np.array([x for x in (ids or pa.array([])).to_pylist() if x is not None], np.int64)))
                    size, at = size + len(texts[-1]), at + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), batch.column(1).slice(start, at - start), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select(rows["doc_id"].cast("long"), rows["ids"].cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe()), byte_bpe())
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


ORACLE = None
