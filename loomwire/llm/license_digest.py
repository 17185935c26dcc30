"""Licence scan by canonical digest (operator 10, DataFrame functions only).

A text's canonical form has no case, punctuation, copyright lines or spelling variants; its SHA-256 is joined to the
digests of known licences. Texts are looked up entire: the document as a whole, and each of its lines, since a grant
often stands on a line of its own. One pass canonicalises a document; lines are split from the canonical text.

Defined results: a null or empty text has the digest of the empty string and no licence; repeated rows are scanned
each; a null doc_id is kept; very long texts are scanned whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm._common import read

#: Known tables of at most so many rows are broadcast (well below 10 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
#: Fixed values: (licence, text), grants and short licence texts as their stewards publish them.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]
#: Equivalent spellings, as words of the canonical text.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("favour", "favor"), ("copyright holders", "copyright owners"), ("copyright holder", "copyright owner"), ("noncommercial", "nc"), ("per cent", "percent")]


def canonical(text: Column) -> Column:
    """The canonical text, one line for each that is left."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*$", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    spelled = out
    for old, new in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"\b{old}\b", new)
    # one look at all spellings spares most documents a pass for each
    return F.when(out.rlike(r"\b(?:" + "|".join(old for old, _ in SPELLINGS) + r")\b"), spelled).otherwise(out)


def whole(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, r"\s+", " "))


def known_digests(licences: DataFrame) -> DataFrame:
    """license and digest of a table with license and text."""
    return licences.select("license", F.sha2(whole(canonical(F.col("text"))), 256).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256)).distinct()


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """doc_id, digest, licenses (sorted) and whole_license of `docs` (doc_id, text)."""
    known = known_digests(licences)
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    canon = docs.select("doc_id", canonical(F.col("text").cast("string")).alias("_canon"))
    rows = canon.select("doc_id", F.sha2(whole(F.col("_canon")), 256).alias("digest"), "_canon")
    lines = F.filter(F.transform(F.split("_canon", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.array_union(F.array("digest"), F.transform(F.array_distinct(lines), lambda x: F.sha2(x, 256)))
    found = rows.select("doc_id", F.col("digest").alias("_whole"), F.explode(parts).alias("digest")).join(known, "digest")
    by = found.groupBy(F.col("doc_id").alias("_id"), "_whole").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.min(F.when(F.col("digest") == F.col("_whole"), F.col("license"))).alias("whole_license"))
    out = rows.select("doc_id", "digest").join(by, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_whole")), "left")
    return out.select("doc_id", "digest", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "whole_license")


def licences(spark: SparkSession) -> DataFrame:
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN) + " AS t(license, text)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), licences(spark))
    return out.select("doc_id", "digest", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"), "whole_license")


def _oracle() -> str:
    def canon(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        out = f"regexp_replace({out}, '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        for old, new in SPELLINGS:
            out = f"regexp_replace({out}, '\\b{old}\\b', '{new}', 'g')"
        return out

    values = ", ".join("('" + a + "', '" + b.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for a, b in KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license, sha256(trim(regexp_replace({canon("text")}, '\\s+', ' ', 'g'))) AS digest FROM (VALUES {values}) t(license, text)),
c AS (SELECT row_number() OVER () AS rid, doc_id, {canon("text")} AS canon FROM documents),
d AS (SELECT rid, doc_id, canon, sha256(trim(regexp_replace(canon, '\\s+', ' ', 'g'))) AS digest FROM c),
part AS (SELECT rid, digest AS whole, digest FROM d UNION ALL SELECT rid, digest, sha256(trim(line)) FROM (SELECT rid, digest, unnest(string_split(canon, chr(10))) AS line FROM d) WHERE trim(line) <> ''),
f AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n, min(CASE WHEN digest = whole THEN license END) AS whole_license FROM part JOIN k USING (digest) GROUP BY rid)
SELECT doc_id, digest, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_licenses, whole_license FROM d LEFT JOIN f USING (rid)
"""


ORACLE = _oracle()
