"""Quality classifier as a sparse rule ensemble (operator 9).

Statistics of a text (column expressions) feed a small random forest; each path from a root becomes a conjunctive rule;
a lasso-penalised logistic regression weighs the rules and drops most; the rest is compiled into one column
expression. Scoring is then a projection over the documents: no shuffle, no Python, no model to send.

Learning uses at most `SAMPLE` labelled documents, picked by the hash of their ids; everything else covers all rows.
Inputs of a score are the text's statistics alone.

Defined results: null texts count as empty and are scored; repeated rows are scored each; a document labelled several
times counts once, with its lowest label; with no labels, one class only or no rule, the score is the smoothed share of
label 1; an empty table gives no rows; other columns are kept by `score` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm._common import read

#: At most so many labelled documents are learnt from.
SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 16, 3, 0.002, 7
THRESHOLD = 0.7
NAMES = ["chars", "words", "word_chars", "distinct", "twice", "upper", "digits", "symbols", "shouts", "bars", "stops", "lines", "line_chars", "marks"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs` (with text) plus a struct `_f` of the statistics, all doubles."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"_text": text, "_words": F.filter(F.split(text, r"\s+"), lambda w: w != "")})
    n, m = F.char_length("_text").cast("double"), F.size("_words").cast("double")
    least = lambda c: F.greatest(c, F.lit(1.0))
    count = lambda pattern: F.regexp_count(F.col("_text"), F.lit(pattern)).cast("double")
    lines = F.size(F.split("_text", "\n")).cast("double")
    repeats = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("_words") - 1, F.lit(1))), lambda i: F.get("_words", i) == F.get("_words", i - 1))).cast("double")
    of = {
        "chars": n, "words": m, "word_chars": n / least(m), "distinct": F.size(F.array_distinct("_words")) / least(m), "twice": repeats / least(m), "upper": count(r"\p{Lu}") / least(n), "digits": count("[0-9]") / least(n),
        "symbols": count(r"[#$%&*@^~<>{}=+\\]") / least(n), "shouts": count("[!?]") / least(m), "bars": count(r"[|_/]") / least(m), "stops": count("[.]") / least(m), "lines": lines, "line_chars": n / lines, "marks": count("[,;:]") / least(m),
    }
    return rows.withColumn("_f", F.struct(*[of[k].alias(k) for k in NAMES])).drop("_text", "_words")


Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; a rule is a conjunction of (statistic, '<=' or '>', threshold)."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, at: str = "_f") -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, at), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(rule: Rule, at: str = "_f") -> Column:
    out = F.lit(True)
    for name, way, bound in rule:
        c = F.col(f"{at}.{name}")
        out = out & ((c <= bound) if way == "<=" else (c > bound))
    return out


def paths(node: object, so_far: Rule = ()) -> list[Rule]:
    """The conjunctions of all nodes below the root of a fitted tree, tightest bounds only."""
    if so_far:
        bounds: dict[tuple[str, str], float] = {}
        for name, way, bound in so_far:
            best = min if way == "<=" else max
            bounds[name, way] = best(bound, bounds.get((name, way), bound))
        out = [tuple((n, w, b) for (n, w), b in sorted(bounds.items()))]
    else:
        out = []
    if node.subtreeDepth() > 0:
        split = node.split()
        name, bound = NAMES[split.featureIndex()], split.threshold()
        out += paths(node.leftChild(), (*so_far, (name, "<=", bound))) + paths(node.rightChild(), (*so_far, (name, ">", bound)))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label and statistics of at most about `sample` labelled documents; labels has doc_id and label."""
    labelled = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    n = labelled.count()
    share = int(1_000_000 * min(1.0, sample / max(1, n)))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    # bounded by `sample`, a few hundred kB
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("_f").alias("_f"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    # one sorted partition: the forest's draws, and so the rules, are the same in every run
    rows = training_rows(docs, labels, sample).coalesce(1).sortWithinPartitions("doc_id").select("label", "_f").cache()
    try:
        seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        good, bad = seen.get(1.0, 0), seen.get(0.0, 0)
        share = Ensemble(log((good + 1) / (bad + 1)), ())
        if not good or not bad:
            return share
        stats = rows.select("label", "_f", array_to_vector(F.array(*[F.col(f"_f.{k}") for k in NAMES])).alias("x"))
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=3).fit(stats)
        rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree._call_java("rootNode"))))
        if not rules:
            return share
        hit = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("x"))
        lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(hit)
        return Ensemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6))
    finally:
        rows.unpersist()


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """`docs` with a score between 0 and 1."""
    return with_statistics(docs).withColumn("score", ensemble.column()).drop("_f")


def accepted(docs: DataFrame, ensemble: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `threshold`.

    The observed counts stand between the score and the filter: a filter moved below the projection would work out every
    statistic anew for each rule that names it.
    """
    low = F.count_if(F.col("score") < threshold).alias("rejected")
    return score(docs, ensemble).observe("quality", F.count(F.lit(1)).alias("scored"), low).where(F.col("score") >= threshold)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str) -> Ensemble:
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return learn(read(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text"), fitted(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE = None
