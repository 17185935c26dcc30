"""Feeds landed as files: RSS/Atom items, web-search JSON, and bodies filled from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.functions.text import event_time

RSS = "title string, link string, description string, summary string, content string, pubDate string, updated string"
SEARCH = "query string, results array<struct<title:string,url:string,content:string,publishedDate:string>>"


def plain(text: Column) -> Column:
    """Mark-up taken away, only where there is any."""
    return F.trim(F.when(F.contains(text, F.lit("<")), F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " ")).otherwise(text))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """title, url, body and published of landed RSS files; items without link or title are dropped."""
    return _item(spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path))


def _item(items: DataFrame, *more: str) -> DataFrame:
    body = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("content", "summary", "description")])
    date = F.coalesce("pubDate", "updated")
    plain_date = F.regexp_replace(F.trim(date), r"^[A-Za-z]+,\s*", "")
    at = F.coalesce(*[F.try_to_timestamp(plain_date, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("Z", "z")], event_time(date))
    return items.where((F.trim("title") != "") & (F.trim("link") != "")).select(*more, plain(F.col("title")).alias("title"), F.trim("link").alias("url"), plain(body).alias("body"), at.alias("published"))


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of landed web-search answers; dates without a zone are UTC."""
    return _result(spark.read.schema(SEARCH).json(path).select(F.explode("results").alias("r")))


def _result(rows: DataFrame, *more: str) -> DataFrame:
    return rows.where("r.url <> '' AND r.title <> ''").select(*more, F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.content").alias("body"), F.try_to_timestamp("r.publishedDate").alias("published"))


_FEED = f"channel struct<item: array<struct<{RSS.replace(' ', ': ')}>>>".replace(",: ", ", ")


def _parsed(rows: DataFrame) -> DataFrame:
    """Landed payloads (source, type, file, payload, error) with items of feeds and results of searches, null where unreadable."""
    items = F.when(F.col("type") == "rss", F.from_xml(F.col("payload"), _FEED)["channel"]["item"])
    answer = F.when(F.col("type") == "search", F.from_json("payload", SEARCH)["results"])
    return rows.withColumns({"items": items, "answer": answer})


def fetched(rows: DataFrame) -> DataFrame:
    """source, file, place, title, url, body and published of landed payloads, each read as its source's type asks.

    Feeds and search answers are parsed; a source that pushes has nothing to fetch, an unknown type and a payload that
    can't be read give nothing, and say so in `failures`.
    """
    both, keys = _parsed(rows), ("source", "file", "place")
    feed = both.select("source", "file", F.posexplode("items").alias("place", "i")).select(*keys, "i.*")
    found = both.select("source", "file", F.posexplode("answer").alias("place", "r"))
    return _item(feed, *keys).unionByName(_result(found, *keys))


def failures(rows: DataFrame) -> DataFrame:
    """source, file and error of payloads that gave nothing though they should."""
    none = F.col("type").isin("rss", "search") & F.col("items").isNull() & F.col("answer").isNull()
    error = F.coalesce("error", F.when(~F.col("type").isin("rss", "search", "pushed"), F.concat(F.lit("unknown type "), "type")), F.when(none, F.lit("unreadable")))
    return _parsed(rows).select("source", "file", error.alias("error")).where("error IS NOT NULL")


def filled(articles: DataFrame, pages: DataFrame, least: int = 600) -> DataFrame:
    """Short bodies replaced by the page's text (url, body) where that is longer."""
    p = pages.select("url", F.col("body").alias("_page"))
    short = (F.char_length(F.coalesce("body", F.lit(""))) < least) & (F.char_length("_page") > F.char_length(F.coalesce("body", F.lit(""))))
    return articles.join(p, "url", "left").withColumn("body", F.when(short, F.col("_page")).otherwise(F.col("body"))).drop("_page")
