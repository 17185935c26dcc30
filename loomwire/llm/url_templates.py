"""URL filter by path-template trees (operator 8, DataFrame functions only).

Each host has a tree over its paths' segments. At a node, segments with digits and segments seen on fewer than
`support` pages are variable and become one wildcard; siblings whose labelled purity lies significantly on the same
side of one half, or on neither, are merged. What is left is a template, and a template whose smoothed labelled purity
is below `reject_below` is rejected. Purity is smoothed towards one half, so a template without labels passes.

The tree is grown level by level over the distinct paths, down to the last segment of the longest, with counts made
before each shuffle and a level's table written once; paths that have ended are set aside and not carried on. No node is
ever gathered.

In the registered query explicit rules come first, longest rule first; the pages they decide are the labelled ones,
and the method judges all other pages.

Defined results: a null url, or one without `://`, has an empty host and path and the template of that node; an empty
table gives no rows; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.llm._common import read, stored

SUPPORT, SMOOTHING, REJECT_BELOW, Z = 5, 4.0, 0.35, 1.96
#: Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict. Rules are a short list: they become one expression."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda value: reduce(lambda acc, r: F.when(fits(r[1], r[2]), value(r)).otherwise(acc), reversed(ordered), F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _side(good: Column, bad: Column) -> Column:
    """+ or - where the purity differs from one half by more than chance (Wilson's interval), else 0."""
    n = (good + bad).cast("double")
    p, z2 = good / F.greatest(n, F.lit(1.0)), Z * Z
    mid = (p + z2 / (2 * F.greatest(n, F.lit(1.0)))) / (1 + z2 / F.greatest(n, F.lit(1.0)))
    half = Z * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1.0)) + z2 / (4 * F.greatest(n, F.lit(1.0)) * F.greatest(n, F.lit(1.0)))) / (1 + z2 / F.greatest(n, F.lit(1.0)))
    return F.when(n == 0, "0").when(mid - half > 0.5, "+").when(mid + half < 0.5, "-").otherwise("0")


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """host, path and template of every distinct path; `pages` has host, path and label (1 good, 0 bad, null none)."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    out = ["host", "path", "template", "n", "good", "bad"]
    paths = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    segs = F.split("path", "/")
    active = stored(paths.select("*", F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))).alias("segs"), F.lit("").alias("template")))
    deepest = active.agg(F.max(F.size("segs"))).first()[0] or 0
    ended = []
    for level in range(deepest):
        ended.append(active.where(F.size("segs") <= level).select(*out))
        paths = active.where(F.size("segs") > level).withColumn("seg", F.col("segs")[level])
        children = paths.groupBy("host", "template", "seg").agg(*sums)
        variable = (F.col("n") < support) | F.col("seg").rlike("[0-9]")
        children = children.withColumn("branch", F.when(variable, "*").otherwise(F.col("seg")))
        branches = children.groupBy("host", "template", "branch").agg(*sums).withColumn("side", _side(F.col("good"), F.col("bad")))
        merged = branches.groupBy("host", "template", "side").agg(F.count(F.lit(1)).alias("alike"))
        token = F.when(F.col("alike") > 1, F.concat(F.lit("*"), "side")).otherwise(F.col("branch"))
        named = branches.join(merged, ["host", "template", "side"]).select("host", "template", "branch", token.alias("token"))
        to = children.join(named, ["host", "template", "branch"]).select("host", "template", "seg", "token")
        grown = paths.join(to, ["host", "template", "seg"])
        active = stored(grown.select("host", "path", "n", "good", "bad", "segs", F.concat("template", F.lit("/"), "token").alias("template")))
    return reduce(DataFrame.unionByName, ended, active.select(*out))


def judged(paths: DataFrame, smoothing: float = SMOOTHING, reject_below: float = REJECT_BELOW) -> DataFrame:
    """host, path, template, purity and verdict of every distinct path."""
    by = paths.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    purity = (F.col("good") + smoothing / 2) / (F.col("good") + F.col("bad") + smoothing)
    by = by.select("host", "template", purity.alias("purity")).withColumn("verdict", F.when(F.col("purity") < reject_below, "block").otherwise("allow"))
    return paths.select("host", "path", "template").join(by, ["host", "template"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    pages = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES)
    pages = pages.select("*", rule.alias("rule"), verdict.alias("said"))
    label = F.when(F.col("said") == "allow", 1).when(F.col("said") == "block", 0)
    method = judged(templates(pages.select("host", "path", label.alias("label"))))
    out = pages.join(method, ["host", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "verdict").alias("verdict"), "template")


#: Levels that the SQL is written out for; the given tables have no longer paths.
_UNROLLED = 6


def _oracle() -> str:
    z2 = f"({Z} * {Z})"
    m = "greatest(good + bad, 1.0)"
    mid, half = f"(good / {m} + {z2} / (2 * {m})) / (1 + {z2} / {m})", f"{Z} * sqrt(good / {m} * (1 - good / {m}) / {m} + {z2} / (4 * {m} * {m})) / (1 + {z2} / {m})"
    side = f"CASE WHEN good + bad = 0 THEN '0' WHEN {mid} - {half} > 0.5 THEN '+' WHEN {mid} + {half} < 0.5 THEN '-' ELSE '0' END"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda v: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v((a, h, p))}'" for a, h, p in ordered) + " END"
    sql = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
pg AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS said FROM hp),
p0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS good, count(*) FILTER (WHERE said = 'block') AS bad, '' AS template,
  string_split(path, '/')[2:] AS segs
  FROM pg GROUP BY host, path)"""
    for i in range(_UNROLLED):
        sql += f""",
c{i} AS (SELECT host, template, segs[{i + 1}] AS seg, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM p{i} WHERE len(segs) > {i} GROUP BY ALL),
k{i} AS (SELECT *, CASE WHEN n < {SUPPORT} OR regexp_matches(seg, '[0-9]') THEN '*' ELSE seg END AS branch FROM c{i}),
b{i} AS (SELECT host, template, branch, {side} AS side FROM (SELECT host, template, branch, sum(good) AS good, sum(bad) AS bad FROM k{i} GROUP BY ALL)),
m{i} AS (SELECT host, template, branch, CASE WHEN count(*) OVER (PARTITION BY host, template, side) > 1 THEN '*' || side ELSE branch END AS token FROM b{i}),
t{i} AS (SELECT k.host, k.template, k.seg, token FROM k{i} k JOIN m{i} m ON k.host = m.host AND k.template = m.template AND k.branch = m.branch),
p{i + 1} AS (SELECT p.host, p.path, n, good, bad, p.template || coalesce('/' || token, '') AS template, segs FROM p{i} p LEFT JOIN t{i} t ON p.host = t.host AND p.template = t.template AND segs[{i + 1}] = t.seg AND len(segs) > {i})"""
    return (
        sql
        + f""",
v AS (SELECT host, template, CASE WHEN (sum(good) + {SMOOTHING / 2}) / (sum(good) + sum(bad) + {SMOOTHING}) < {REJECT_BELOW} THEN 'block' ELSE 'allow' END AS verdict FROM p{_UNROLLED} GROUP BY ALL)
SELECT page_id, pg.host, pg.path, rule, coalesce(said, verdict) AS verdict, p{_UNROLLED}.template FROM pg JOIN p{_UNROLLED} ON pg.host = p{_UNROLLED}.host AND pg.path = p{_UNROLLED}.path JOIN v ON v.host = pg.host AND v.template = p{_UNROLLED}.template
"""
    )


ORACLE = _oracle()
