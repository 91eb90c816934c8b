"""Landed feed files -> items (S1-S4, P5, P6), RSS 2.0 and Atom, batch or stream.

Feeds are fetched outside Spark and landed as files under ``<root>/<source_id>/``. A source
type of ``registry.py`` reads whole files as rows (path, value); a feed file is a bounded
document. ``from_xml`` turns each into its entries, so title, entries, their order and the
verdict on the file come from one parse; no second scan is joined by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.text import strip_html
from curata.sources.registry import landed

_LINK = "array<struct<_href:string,_rel:string>>"
FEED_SCHEMA = f"""channel struct<title:string,item:array<struct<title:string,link:string,description:string,
encoded:string,pubDate:string,updated:string,author:string,creator:string,guid:string,category:array<string>>>>,
title string, entry array<struct<title:string,link:{_LINK},summary:string,content:string,published:string,
updated:string,id:string,author:struct<name:string>,category:array<struct<_term:string>>>>, _corrupt_record string"""

SOURCE_SCHEMA = "id string, type string, enabled boolean, weight double"


def feed_time(name: str | Column) -> Column:
    """RFC 822 feed date (weekday optional, zone name or offset) or ISO-8601
    -> timestamp (UTC session); NULL when unparsable."""
    raw = F.trim(F.col(name) if isinstance(name, str) else name)
    s = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm Z")),
        F.regexp_replace(raw, "Z$", "+00:00").try_cast("timestamp"))


def _first(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def _rss_entry(e: Column) -> Column:
    return F.struct(
        e["title"].alias("title"), _first(e["link"]).alias("link"), _first(e["description"], e["encoded"]).alias("summary"),
        _first(e["author"], e["creator"]).alias("author"), _first(e["pubDate"]).alias("published"),
        _first(e["updated"]).alias("updated"), _first(e["guid"]).alias("guid"), e["category"].alias("tags"))


def _atom_entry(e: Column) -> Column:
    # the alternate link, else the first one
    usual = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(usual, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])
    return F.struct(
        e["title"].alias("title"), _first(link).alias("link"), _first(e["summary"], e["content"]).alias("summary"),
        _first(e["author"]["name"]).alias("author"), _first(e["published"]).alias("published"),
        _first(e["updated"]).alias("updated"), _first(e["id"]).alias("guid"),
        F.transform(e["category"], lambda c: c["_term"]).alias("tags"))


def parse_feeds(files: DataFrame) -> DataFrame:
    """(source_id, path, feed_title, entries, error) of whole feed files (path, value). A file
    that is not well-formed, or holds no entry, has an ``error``."""
    feed = F.from_xml("value", FEED_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
                                             "ignoreNamespace": "true"})
    none = F.array()
    return files.select("path", feed.alias("f")).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("source_id"), "path",
        _first(F.col("f.channel.title"), F.col("f.title")).alias("feed_title"),
        F.concat(F.coalesce(F.transform("f.channel.item", _rss_entry), none),
                 F.coalesce(F.transform("f.entry", _atom_entry), none)).alias("entries"),
        F.col("f._corrupt_record").isNotNull().alias("broken"),
    ).withColumn("error", F.when(F.col("broken"), F.lit("ParseError: not well-formed XML"))
                 .when(F.size("entries") == 0, F.lit("EmptyFeed: no entries"))).drop("broken")


def feed_entries(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """One item per usable entry (link and stripped title non-empty) of the enabled
    sources (id, enabled, weight; ``position`` if their order is not that of their ids).
    Items are ordered by (source_position, path, row): the source's place, the file's name and
    the entry's number within its file."""
    place = F.col("position") if "position" in sources.columns else F.lit(0)
    known = sources.where(F.coalesce("enabled", F.lit(True))).select(
        F.col("id").alias("source_id"), F.coalesce("weight", F.lit(1.0)).alias("source_weight"),
        place.alias("source_position"))
    rows = (parsed.join(known, "source_id")
            .select("source_id", "source_weight", "source_position", "path", "feed_title",
                    F.posexplode("entries").alias("row", "e")))
    tags = F.filter(F.coalesce(F.col("e.tags"), F.array().cast("array<string>")), lambda t: t != "")
    return rows.select(
        "source_position", "path", "row", "source_id", F.col("e.link").alias("url"),
        strip_html(F.coalesce(F.col("e.title"), F.lit(""))).alias("title"), strip_html(F.col("e.summary")).alias("summary"),
        F.col("e.author").alias("author"),
        F.coalesce(feed_time(F.col("e.published")), feed_time(F.col("e.updated"))).alias("published_at"),
        "source_weight",
        F.struct("feed_title", tags.alias("tags"), "source_weight", F.col("e.guid").alias("guid")).alias("metadata"),
    ).where((F.col("url") != "") & (F.col("title") != ""))


FEED_ORDER = ["source_position", "source_id", "path", "row"]


def source_errors(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, error) of enabled sources none of whose files gave an entry; a file
    that fails never stops the others."""
    counts = parsed.groupBy("source_id").agg(
        F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"),
        F.min(F.struct("path", "error")).getField("error").alias("first_error"))
    enabled = sources.where(F.coalesce("enabled", F.lit(True))).select(F.col("id").alias("source_id"))
    return counts.join(enabled, "source_id").where("good = 0 AND bad > 0").select(
        "source_id", F.concat("first_error", F.lit(" ("), F.col("bad").cast("string"), F.lit(" files)")).alias("error"))


def scan_feeds(spark: SparkSession, root: str, sources: DataFrame, type_: str = "files") -> tuple[DataFrame, DataFrame]:
    """(items, source_errors) of the feed files below ``root``."""
    parsed = parse_feeds(landed(spark, type_, root))
    return feed_entries(parsed, sources), source_errors(parsed, sources)
