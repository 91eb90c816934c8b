"""Publication pass (C15, S12-S14): one published view, read from the store, gives the RSS and
JSON feed documents, the search index and the site statistics.

A feed is one bounded text row (its first ``FEED_LIMIT`` posts); the search index has a line
per post and stays a table of JSON lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions.text import xml_escape
from curata.operators.publish import json_feed, json_feed_items, published_articles, rss_items, search_index, view
from curata.session import stored
from curata.sources.store import ArticleStore


def published_view(store: ArticleStore, items: DataFrame) -> DataFrame:
    """The passed articles with their children and their items' date and source."""
    passed = store.articles().where(F.col("quality_status") == "pass")
    return view(published_articles(store.with_children(passed), items))


def rss_document(v: DataFrame, title: str, description: str, built_at: str, base_url: str = "") -> DataFrame:
    """One row ``value``, the whole RSS 2.0 document (a text file adds its last line feed)."""
    listed = F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros("date")).alias("k"), (-F.col("article_id")).alias("k2"), "item")))
    built = F.date_format(F.to_timestamp(F.lit(built_at)), "EEE, dd MMM yyyy HH:mm:ss Z")
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>'), xml_escape(F.lit(title)),
        F.lit("</title><link>"), xml_escape(F.lit(base_url or "index.html")), F.lit("</link><description>"),
        xml_escape(F.lit(description)), F.lit("</description><lastBuildDate>"), built, F.lit("</lastBuildDate>"))
    return rss_items(v, base_url).agg(F.array_join(F.transform(listed, lambda x: x["item"]), "").alias("items")).select(
        F.concat(head, "items", F.lit("</channel></rss>")).alias("value"))


def publish(store: ArticleStore, items: DataFrame, out: str, title: str, description: str, built_at: str,
            base_url: str = "") -> dict[str, int]:
    """Write ``feed.xml``, ``feed.json`` and ``search.json`` below ``out`` (each a folder of
    Spark text files, replaced as a whole) and return the site statistics."""
    v = stored(published_view(store, items), "published-view")
    rss_document(v, title, description, built_at, base_url).coalesce(1).write.mode("overwrite").text(
        f"{out}/feed.xml")
    json_feed(json_feed_items(v, base_url), title, description, base_url).coalesce(1).write.mode("overwrite").text(
        f"{out}/feed.json")
    search_index(v).write.mode("overwrite").json(f"{out}/search.json")
    counts = v.agg(F.count(F.lit(1)).alias("posts"), F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"))
    tags = v.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("tags"))
    return counts.first().asDict() | tags.first().asDict()
