"""The corpus pipeline: documents through five operators, each stage's rows written and read again.

run() returns what packing returns: pieces of the documents that are left, with their tokens and places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm import decontaminate, harmonic_packing, line_dedup, order_minhash, rule_quality
from loomwire.llm._common import read, stored


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all else in one column, so that no name of a further column meets an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("_rest")] if rest else []))


def _full(slim: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of `docs` again; n_chars follows a changed text."""

    def column(c: str):  # noqa: ANN202
        if c == "n_chars" and changed:
            return F.char_length("text").cast("long").alias(c)
        return F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c)

    return slim.select(*[column(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored below the threshold go. Learnt from the labelled rows of the stage's own input."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").withColumnRenamed("quality", "label")
    labels = labels.where(~rule_quality.held_out(labels["doc_id"]))
    slim = _slim(docs)
    return _full(rule_quality.accepted(slim, rule_quality.learn(slim, labels)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: a line goes where an earlier document or line has it, but for a few edits; all other lines stay."""
    return _full(line_dedup.remove_repeats(_slim(docs), left=0), docs, changed=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each class of near duplicates stays."""
    return _full(order_minhash.keep_first(_slim(docs)), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages of benchmark items are cut out; documents made of them go."""
    found = decontaminate.find(_slim(docs), read(spark, sf_dir, "benchmark"))
    return _full(decontaminate.remove(found), docs, changed=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token sequences of at most 2048 with little padding."""
    return harmonic_packing.pack(docs, harmonic_packing.byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", packing),
]

#: No stage but the last could be told in SQL: learnt rules, edit joins and alignments. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
