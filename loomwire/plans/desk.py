"""Registered queries of the desk: list views, projections, reviews, state changes and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire import model as M
from loomwire.functions import text as X
from loomwire.functions import triage
from loomwire.model import sql
from loomwire.operators import dedup, desk, vectors, views
from loomwire.params import DEFAULTS as P
from loomwire.plans.catalogue import _UNIT, _round, _stamp, _triage_sql, query, rounded, stamp
from loomwire.session import table

_EVENT_TIME = "CASE WHEN event_id % 3 = 0 THEN created_at - to_hours(CAST(event_id % 5 AS INT)) END"
_SRC_JOIN = f"j AS (SELECT e.*, {_EVENT_TIME} AS event_time, a.url, a.title, s.name AS source FROM ev e LEFT JOIN art a ON a.doc_id = e.event_id LEFT JOIN src s ON s.name = a.source)"


def _joined_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their article and source, both of which may be missing, and their own time where known."""
    at = F.when(F.col("event_id") % 3 == 0, F.timestamp_micros(F.unix_micros("created_at") - (F.col("event_id") % 5) * 3_600_000_000))
    e = M.events(spark, d).withColumn("event_time", at)
    a = M.articles(spark, d).select(F.col("doc_id").alias("event_id"), "url", "title", F.col("source").alias("name"))
    s = M.sources(spark, d).select("name", F.col("name").alias("source"))
    return e.join(a, "event_id", "left").join(s, "name", "left").withColumn("occurred_at", F.coalesce("event_time", "created_at"))


@query(sql("ev src art", f"SELECT event_id, url, source, {_stamp('coalesce(event_time, created_at)')} AS occurred_at FROM j ORDER BY created_at DESC, event_id DESC LIMIT 200", _SRC_JOIN))
def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = views.feed(_joined_events(spark, d), "recent")
    return rows.select("event_id", "url", "source", stamp("occurred_at").alias("occurred_at"))


@query(sql("ev src art", "SELECT cluster_id, event_id, url, source, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(event_time, created_at), event_id) AS place FROM j WHERE cluster_id IS NOT NULL) WHERE place <= 500", _SRC_JOIN))
def timeline_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = _joined_events(spark, d).where("cluster_id IS NOT NULL")
    return views.per_key(rows, "cluster_id", [F.col("occurred_at"), F.col("event_id")], 500).select("cluster_id", "event_id", "url", "source", "place")


@query(sql("ev src art", "SELECT cluster_id, event_id, coalesce(nullif(title, ''), category) AS title, source, round(credibility::DOUBLE, 4) AS credibility, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY credibility DESC, created_at DESC, event_id) AS place FROM j WHERE cluster_id IS NOT NULL) WHERE place <= 10", _SRC_JOIN))
def dispatch_payload_events(spark: SparkSession, d: str) -> DataFrame:
    rows = views.per_key(_joined_events(spark, d).where("cluster_id IS NOT NULL"), "cluster_id", [F.desc("credibility"), F.desc("created_at"), F.col("event_id")], 10)
    return rows.select("cluster_id", "event_id", F.coalesce(F.nullif("title", F.lit("")), "category").alias("title"), "source", F.round("credibility", 4).alias("credibility"), "place")


@query(sql("ev", f"SELECT event_id, verdict, total, list_sort([urgency, impact])[2]::DOUBLE AS peak, (event_id % 10 >= 5)::INT AS updates FROM {_triage_sql(P.sensitivity)}"))
def event_projection(spark: SparkSession, d: str) -> DataFrame:
    """The public row of an event: its triage as one structure, its updates as a number."""
    e = triage.scored(M.events(spark, d)).withColumn("event_updates", F.when(F.col("event_id") % 10 >= 5, F.array("event_id")).otherwise(F.array().cast("array<bigint>")))
    row = e.select("event_id", F.struct("verdict", "total", F.greatest("urgency", "impact").alias("peak")).alias("triage"), F.size("event_updates").alias("updates"))
    return row.select("event_id", "triage.verdict", "triage.total", "triage.peak", "updates")


@query("SELECT o_orderkey AS assessment_id, f.force, f.weight, o_totalprice AS impact FROM orders JOIN (SELECT DISTINCT o_orderpriority AS force, length(o_orderpriority) AS weight FROM orders) f ON f.force = o_orderpriority")
def forces_with_assessments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    forces = o.select(F.col("o_orderpriority").alias("force")).distinct().withColumn("weight", F.char_length("force").cast("long"))
    return o.select(F.col("o_orderkey").alias("assessment_id"), F.col("o_orderpriority").alias("force"), F.col("o_totalprice").alias("impact")).join(forces, "force").select("assessment_id", "force", "weight", "impact")


@query("SELECT l_partkey AS entity_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS event_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey")
def newest_event_per_entity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderdate")
    return M.mentions(spark, d).join(o, "event_id").groupBy("entity_id").agg(F.max_by("event_id", F.struct("o_orderdate", "event_id")).alias("event_id"))


@query("SELECT c_custkey AS cluster_id FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def clusters_without_members(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"))
    return views.without(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cluster_id")), members, "cluster_id")


@query("SELECT DISTINCT c_nationkey AS cluster_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS")
def cooldown_through_signals(spark: SparkSession, d: str) -> DataFrame:
    """Clusters (nations) with a recent dispatch of one of their signals (customers)."""
    o = M.dispatches(spark, d)
    recent = views.recently_reasoned(o, o.agg(F.max("created_at")).first()[0], 30 * 24).withColumnRenamed("ref_id", "c_custkey")
    return table(spark, d, "customer").join(recent, "c_custkey", "left_semi").select(F.col("c_nationkey").alias("cluster_id")).distinct()


@query("SELECT count(*) AS events, count(vec_id) AS with_vector, count(*) - count(vec_id) AS missing FROM events LEFT JOIN embeddings ON vec_id = event_id")
def events_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = M.vectors(spark, d).select("event_id", F.lit(1).alias("has"))
    return M.events(spark, d).select("event_id").join(v, "event_id", "left").agg(F.count(F.lit(1)).alias("events"), F.count("has").alias("with_vector"), F.count_if(F.col("has").isNull()).alias("missing"))


_WS = "ws AS (SELECT doc_id AS signal_id, (doc_id * 37 % 101) / 100.0 AS combined, CASE WHEN toxic = 1 THEN 'dismissed' ELSE 'open' END AS status FROM labels)"


@query("WITH " + _WS + " SELECT signal_id, combined::DOUBLE AS combined, status FROM ws WHERE status = 'open' ORDER BY combined DESC, signal_id LIMIT 200")
def weak_signals_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("signal_id"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("combined"), F.when(F.col("toxic") == 1, "dismissed").otherwise("open").alias("status"))
    return desk.page(rows, [F.desc("combined"), F.col("signal_id")], 200, status="open")


@query(sql("ev", "SELECT event_id AS scenario_id, cluster_id FROM ev ORDER BY created_at DESC, event_id DESC LIMIT 50"))
def scenarios_list(spark: SparkSession, d: str) -> DataFrame:
    rows = M.events(spark, d).select(F.col("event_id").alias("scenario_id"), "cluster_id", "created_at")
    return desk.page(rows, [F.desc("created_at"), F.desc("scenario_id")], 50).select("scenario_id", "cluster_id")


@query(sql("ent men", "SELECT e.entity_id, coalesce(n, 0) AS mentions, coalesce(surfaces, '') AS surfaces FROM ent e LEFT JOIN (SELECT entity_id, count(*) AS n, max(event_id) AS last, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces FROM men GROUP BY entity_id) USING (entity_id) ORDER BY coalesce(n, 0) DESC, last DESC NULLS LAST, e.entity_id LIMIT 100 OFFSET 20"))
def entities_list(spark: SparkSession, d: str) -> DataFrame:
    by = M.mentions(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"), F.max("event_id").alias("last"), F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))
    rows = M.entities(spark, d).join(by, "entity_id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))).withColumn("surfaces", F.coalesce("surfaces", F.lit("")))
    return desk.page(rows, [F.desc("mentions"), F.desc_nulls_last("last"), F.col("entity_id")], 100, 20).select("entity_id", "mentions", "surfaces")


@query("SELECT c_custkey AS cluster_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE c_acctbal > 0 ORDER BY last_seen DESC NULLS FIRST, c_custkey LIMIT 100")
def active_clusters_list(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    rows = table(spark, d, "customer").where("c_acctbal > 0").join(seen, "c_custkey", "left").withColumnRenamed("c_custkey", "cluster_id")
    return desk.page(rows, [F.desc_nulls_first("last_seen"), F.col("cluster_id")], 100).select("cluster_id")


@query(sql("src", f"SELECT name, {_round('credibility::DOUBLE')} AS credibility, CASE right(name, 1) WHEN '7' THEN 'push' WHEN '3' THEN 'search' ELSE 'rss' END AS type FROM src WHERE right(name, 1) <> '7'"))
def sources_polled(spark: SparkSession, d: str) -> DataFrame:
    """Sources by type, by name; a push source polls nothing."""
    kind = F.when(F.col("name").endswith("7"), "push").when(F.col("name").endswith("3"), "search").otherwise("rss")
    return rounded(M.sources(spark, d).withColumn("type", kind).where("type <> 'push'").orderBy("name"), ["credibility"])


_ACT = "ac AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN category END AS action, CASE WHEN event_id % 6 = 0 THEN [] ELSE ['a' || (event_id % 9)] END AS actors FROM ev)"


def _acted(spark: SparkSession, d: str) -> DataFrame:
    actors = F.when(F.col("event_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), F.col("event_id") % 9)))
    return M.events(spark, d).withColumn("action", F.when(F.col("event_id") % 4 > 0, F.col("category"))).withColumn("actors", actors)


@query(sql("ev", "SELECT count(*) FILTER (WHERE len(actors) = 0 OR action IS NULL) AS incomplete, count(*) FILTER (WHERE NOT (len(actors) = 0 OR action IS NULL)) AS complete FROM ac", _ACT))
def incomplete_events(spark: SparkSession, d: str) -> DataFrame:
    bad = desk.incomplete(F.col("actors"), F.col("action"))
    return _acted(spark, d).agg(F.count_if(bad).alias("incomplete"), F.count_if(~bad).alias("complete"))


@query(sql("asof ev", f"SELECT event_id, (SELECT count(*) FROM k) AS available, (SELECT count(*) FROM k) > 300 AS truncated FROM k ORDER BY created_at DESC, event_id DESC LIMIT 300", _ACT + f", k AS (SELECT event_id, created_at FROM ac, now_ WHERE NOT (len(actors) = 0 OR action IS NULL) AND created_at >= t - INTERVAL {P.cluster_days} DAYS)"))
def clustering_window(spark: SparkSession, d: str) -> DataFrame:
    """Complete events of the look-back, newest first, up to a stated number, with how many there are."""
    since = F.timestamp_seconds(F.lit(M.as_of(spark, d).timestamp() - P.cluster_days * 86400))
    rows = _acted(spark, d).where(~desk.incomplete(F.col("actors"), F.col("action")) & (F.col("created_at") >= since))
    return desk.newest_capped(rows, "created_at", "event_id", 300).select("event_id", "available", "truncated")


_RISK = "rk AS (SELECT p_partkey AS entity_id, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'generic' WHEN 2 THEN 'split' ELSE 'none' END AS risk, CASE WHEN p_size % 7 = 0 THEN 'rejected' ELSE 'auto' END AS status, CASE WHEN p_size % 3 = 0 THEN 'linked' END AS qid_status FROM part)"


def _risky(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_id"), F.when(s % 5 == 0, None).when(s % 5 == 1, "generic").when(s % 5 == 2, "split").otherwise("none").alias("risk"), F.when(s % 7 == 0, "rejected").otherwise("auto").alias("status"), F.when(s % 3 == 0, "linked").alias("qid_status")
    )


@query("WITH " + _RISK + " SELECT entity_id FROM rk WHERE (risk IS NULL OR risk NOT IN ('generic', 'split')) AND status <> 'rejected'")
def candidates_without_risk(spark: SparkSession, d: str) -> DataFrame:
    return _risky(spark, d).where(desk.null_safe(F.col("risk"), ["generic", "split"]) & (F.col("status") != "rejected")).select("entity_id")


@query("WITH " + _RISK + " SELECT entity_id FROM rk WHERE (risk IS NULL OR risk <> 'generic') AND (qid_status IS NULL OR qid_status <> 'linked') AND status = 'auto'")
def link_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _risky(spark, d).where(desk.null_safe(F.col("risk"), ["generic"]) & desk.null_safe(F.col("qid_status"), ["linked"]) & (F.col("status") == "auto")).select("entity_id")


@query("SELECT status, confidence, count(*) AS n FROM (SELECT CASE WHEN entity_id % 4 = 0 THEN 'confirmed' WHEN entity_id % 4 = 1 THEN 'rejected' ELSE status END AS status, CASE WHEN entity_id % 4 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM rk) GROUP BY ALL".join(["WITH " + _RISK + " ", ""]))
def entity_reviews(spark: SparkSession, d: str) -> DataFrame:
    e = _risky(spark, d).select("entity_id", F.col("status").alias("review_status"), F.lit(0.5).alias("confidence"))
    r = e.where("entity_id % 4 < 2").select("entity_id", F.when(F.col("entity_id") % 4 == 0, "confirm").otherwise("reject").alias("decision"))
    return desk.reviewed(e, r).groupBy(F.col("review_status").alias("status"), "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT entity_id, array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') AS aliases, sum(n)::BIGINT AS mention_count, coalesce(min(t), 'unknown') AS type FROM ("
    "SELECT p_partkey AS entity_id, [p_brand] AS a, 1 AS n, CASE WHEN p_size % 2 = 0 THEN 'place' END AS t FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT l_partkey, [l_returnflag || '-' || l_linestatus], 1, NULL FROM lineitem) GROUP BY entity_id"
)
def entity_persist(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the entities are stored; mentions widen their aliases and counts, and add the others."""
    p = table(spark, d, "part").where("p_partkey % 3 <> 0")
    stored = p.select(F.col("p_partkey").alias("entity_id"), F.array("p_brand").alias("aliases"), F.lit(1).cast("long").alias("mention_count"), F.when(F.col("p_size") % 2 == 0, "place").otherwise("unknown").alias("type"), F.lit(0).cast("long").alias("last_seen"))
    # surfaces are reduced to their distinct ones before they meet in one array
    m = M.mentions(spark, d).groupBy("entity_id", "surface").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("at"))
    counts = m.groupBy("entity_id").agg(F.sum("n").alias("n"))
    found = m.select("entity_id", F.array("surface").alias("aliases"), F.lit("unknown").alias("type"), "at")
    once = found.groupBy("entity_id").agg(F.array_sort(F.flatten(F.collect_list("aliases"))).alias("aliases"), F.first("type").alias("type"), F.max("at").alias("at"))
    out = desk.persisted(stored, once).join(counts, "entity_id", "left")
    return out.select("entity_id", F.array_join("aliases", ",").alias("aliases"), (F.col("mention_count") + F.coalesce(F.col("n") - 1, F.lit(0))).alias("mention_count"), "type")


@query("SELECT p_partkey AS entity_id, array_to_string(list_sort(list_filter(list_distinct([p_brand] || string_split(p_type, ' ')), lambda x: NOT (list_contains(string_split(p_type, ' '), x) AND x <> string_split(p_type, ' ')[1]))), ',') AS aliases FROM part")
def alias_narrowing(spark: SparkSession, d: str) -> DataFrame:
    """The type's words move away, but its first is still used."""
    words = F.split("p_type", " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.array_join(F.array_sort(desk.narrowed(F.array_distinct(F.concat(F.array("p_brand"), words)), words, F.slice(words, 1, 1))), ",").alias("aliases"))


@query("SELECT p_size AS asked, p_partkey AS found, place::INT AS place FROM (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY part, p_partkey) AS place FROM (SELECT p_size, p_partkey, min(part) AS part FROM (SELECT p_size, p_partkey, 0 AS part FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_size, p_partkey, 1 FROM part WHERE p_partkey % 2 = 0) GROUP BY ALL)) WHERE place <= 8")
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Prefix hits before full-text hits, each once, the first eight of a question."""
    p = table(spark, d, "part").select(F.col("p_size").alias("asked"), F.col("p_partkey").alias("found"), F.col("p_partkey").alias("place"))
    return desk.first_of_each([p.where("found % 5 = 0"), p.where("found % 2 = 0")], ["found"], "asked", 8).select("asked", "found", "place")


@query("SELECT event_id, CASE WHEN m IS NULL THEN 'none' WHEN m >= n OR sure < 0.8 THEN 'review' ELSE 'linked' END AS decision FROM (SELECT event_id, (event_id % 4) AS n, CASE WHEN event_id % 7 > 0 THEN event_id % 5 END AS m, (event_id % 10) / 10.0 AS sure FROM events)")
def candidate_choice(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    offered = F.slice(F.array(*[F.lit(i).cast("long") for i in range(4)]), F.lit(1), (k % 4).cast("int"))
    return table(spark, d, "events").select("event_id", desk.choice(offered, F.when(k % 7 > 0, k % 5), (k % 10) / 10.0).alias("decision"))


@query("SELECT a, b, NOT (coalesce(qa <> qb, false) OR (ta = 'person' AND tb IN ('organisation', 'place', 'team')) OR (tb = 'person' AND ta IN ('organisation', 'place', 'team'))) AS may FROM (SELECT p_partkey AS a, p_partkey + 1 AS b, CASE WHEN p_partkey % 3 > 0 THEN 'Q' || (p_partkey // 3) END AS qa, CASE WHEN (p_partkey + 1) % 3 > 0 THEN 'Q' || ((p_partkey + 1) // 3) END AS qb, ['person', 'place', 'team', 'unknown'][p_partkey % 4 + 1] AS ta, ['person', 'place', 'team', 'unknown'][(p_partkey + 1) % 4 + 1] AS tb FROM part)")
def merge_eligibility(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    qid = lambda x: F.when(x % 3 > 0, F.concat(F.lit("Q"), F.floor(x / 3)))
    kind = lambda x: F.get(F.array(*map(F.lit, ("person", "place", "team", "unknown"))), (x % 4).cast("int"))
    return table(spark, d, "part").select(k.alias("a"), (k + 1).alias("b"), desk.may_merge(qid(k), qid(k + 1), kind(k), kind(k + 1)).alias("may"))


@query("SELECT event_id, 'a' || (event_id % 9) AS actors, CASE WHEN event_id % 4 > 0 THEN event_type END AS action, CASE WHEN event_type = 'click' THEN 'click' ELSE '' END AS categories, left(event_type || repeat('x', 300), 280) AS summary, least(1.0, greatest(0.0, (event_id % 14) / 10.0 - 0.2))::DOUBLE AS confidence, (event_id % 10 + 1)::DOUBLE AS reliability FROM events")
def extraction_coerced(spark: SparkSession, d: str) -> DataFrame:
    """Whole replies: repeated and blank actors, an unknown category, an overlong summary, confidence out of bounds."""
    k = F.col("event_id")
    body = F.to_json(
        F.struct(
            F.array(F.concat(F.lit(" a"), k % 9), F.lit(" "), F.concat(F.lit("a"), k % 9, F.lit(" "))).alias("actors"), F.when(k % 4 > 0, F.concat(F.lit(" "), "event_type")).otherwise("  ").alias("action"), F.array("event_type", F.lit("no such"), F.col("event_type")).alias("categories"),
            F.concat("event_type", F.repeat(F.lit("x"), F.lit(300))).alias("summary"), F.round((k % 14) / 10.0 - 0.2, 1).cast("string").alias("confidence"),
        )
    )
    x = desk.extracted(F.concat(F.lit("<think>{}</think>"), body), ["click"])
    rows = table(spark, d, "events").select("event_id", x.alias("x"), (((k % 10 + 1) / 10.0) * 10).alias("reliability"))
    return rows.select("event_id", F.array_join("x.actors", ",").alias("actors"), "x.action", F.array_join("x.categories", ",").alias("categories"), "x.summary", F.round("x.confidence", 6).alias("confidence"), F.round("reliability", 6).alias("reliability"))


@query(
    sql(
        "ev",
        "SELECT e.event_id, coalesce(last, e.category) AS summary, coalesce(n, 0)::INT AS updates, coalesce(audit, '') AS audit FROM ev e LEFT JOIN u USING (event_id) WHERE e.event_id % 10 < 5",
        "u AS (SELECT event_id - 5 AS event_id, arg_max(category || event_id, (created_at, event_id)) AS last, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY created_at, event_id) AS audit FROM ev WHERE event_id % 10 >= 5 GROUP BY ALL)",
    )
)
def update_merge(spark: SparkSession, d: str) -> DataFrame:
    """Reports with ids ending 5 to 9 update the stories five before them, each with an entry in the audit list."""
    ev = M.events(spark, d)
    new = ev.where("event_id % 10 >= 5").select((F.col("event_id") - 5).alias("event_id"), F.col("created_at").alias("at"), F.concat("category", "event_id").alias("summary"), F.col("event_id").alias("report_id"))
    out = desk.updated(ev.where("event_id % 10 < 5").select("event_id", F.col("category").alias("summary")), new)
    return out.select("event_id", "summary", F.size("event_updates").alias("updates"), F.array_join(F.transform("event_updates", lambda u: u["report_id"].cast("string")), ",").alias("audit"))


@query("SELECT 'credibility' AS rule, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) AS broken FROM lineitem UNION ALL SELECT 'status', count(*) FILTER (WHERE NOT (l_returnflag IN ('A', 'N'))) FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (WHERE NOT (l_quantity > 0)) FROM lineitem")
def constraint_checks(spark: SparkSession, d: str) -> DataFrame:
    rules = {"credibility": F.col("l_discount").between(0, 0.05), "status": F.col("l_returnflag").isin("A", "N"), "quantity": F.col("l_quantity") > 0}
    return desk.violations(table(spark, d, "lineitem"), rules)


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1")
def unique_checks(spark: SparkSession, d: str) -> DataFrame:
    return desk.repeated_keys(M.entities(spark, d), "name")


@query("SELECT doc_id AS dispatch_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = doc_id)")
def orphan_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return desk.orphans(M.verdicts(spark, d), "dispatch_id", M.dispatches(spark, d), "dispatch_id").select("dispatch_id")


@query(sql("dis ver", "SELECT dispatch_id, CASE WHEN verdict IS NOT NULL THEN 'closed' WHEN status = 'F' THEN 'delivered' WHEN dispatch_id % 7 <= 4 THEN 'pending' ELSE 'failed' END AS status FROM dis LEFT JOIN ver USING (dispatch_id)"))
def dispatch_life_cycle(spark: SparkSession, d: str) -> DataFrame:
    rows = M.dispatches(spark, d).join(M.verdicts(spark, d).select("dispatch_id", "verdict"), "dispatch_id", "left")
    return rows.select("dispatch_id", desk.life_cycle(F.col("status") == "F", F.col("verdict"), F.col("dispatch_id") % 7).alias("status"))


@query(sql("dis ver", "SELECT dispatch_id FROM dis WHERE dispatch_id NOT IN (SELECT dispatch_id FROM ver) ORDER BY created_at, dispatch_id LIMIT 50"))
def outbox_sweep(spark: SparkSession, d: str) -> DataFrame:
    return desk.swept(M.dispatches(spark, d), M.verdicts(spark, d), "dispatch_id").select("dispatch_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS number, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'processed' END AS status FROM events")
def failures_isolated(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a queue, every third of them junk: a bad one fails alone."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "junk").otherwise(F.col("event_id").cast("string")).alias("raw"))
    return desk.isolated(rows, F.col("raw").try_cast("long"), "number").select("event_id", "number", "status")


@query(sql("src art", "SELECT doc_id, lang = 'en' AND length(body) >= 200 AS passes FROM art WHERE body IS NOT NULL"))
def gate_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """The gate with another rule in place of credibility."""
    rows = M.articles(spark, d).where("body IS NOT NULL")
    return desk.gated(rows, lambda r: (r["lang"] == "en") & (F.char_length(r["body"]) >= 200)).select("doc_id", "passes")


@query(sql("vec", "SELECT event_id, cluster_id FROM vec WHERE event_id % 10 <> 0 AND created_at >= TIMESTAMP '2024-01-08' ORDER BY event_id LIMIT 20000"))
def vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """Vectors since a day, without deleted ones (every tenth), up to the scan's stated limit."""
    v = M.vectors(spark, d)
    gone = v.where("event_id % 10 = 0").select("event_id")
    rows = views.without(v, gone, "event_id").where(F.col("created_at") >= F.lit("2024-01-08").cast("timestamp"))
    return rows.orderBy("event_id").limit(20_000).select("event_id", "cluster_id")


@query("SELECT doc_id, left(text, 6000) AS body, left(source || ': ' || coalesce(lang, ''), 300) AS label FROM documents WHERE text IS NOT NULL")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that a question shows, cut to the published lengths."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.left("text", F.lit(6000)).alias("body"), F.left(F.concat("source", F.lit(": "), F.coalesce("lang", F.lit(""))), F.lit(300)).alias("label"))


@query("SELECT event_id, trim(regexp_replace(event_type, ' +', ' ', 'g')) AS shown FROM events")
def labels_shortened(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.label(F.trim(F.regexp_replace("event_type", " +", " "))).alias("shown"))
