"""Publication views and feeds.

The published view is one projection over pass-only articles joined with their
items; facets, search index and feeds are derived from it. Feeds keep their
first ``feed_limit`` posts (the feed size is the feature).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.text import abs_url, strip_ws, teaser, xml_escape

FEED_LIMIT = 50


def published_articles(articles: DataFrame, items: DataFrame) -> DataFrame:
    """F6 + J4: pass-only articles with their item's date, source and URL."""
    it = items.select(F.col("item_id"), F.col("published_at").alias("item_published_at"),
                      F.col("source_id").alias("item_source_id"), F.col("url").alias("item_url"))
    return articles.where(F.col("quality_status") == "pass").join(it, "item_id")


def publication_order() -> list[Column]:
    """T4: coalesce(item published, created) desc, id desc."""
    return [F.coalesce("item_published_at", "created_at").desc(), F.desc("article_id")]


def sorted_children(articles: DataFrame) -> DataFrame:
    """Sources primary first, comparisons by similarity desc (stable by
    position otherwise), sorted inside each row: no shuffle."""
    return articles.withColumns({
        "sources": F.transform(F.array_sort(F.transform("sources", lambda s, i: F.struct(
            (~s["is_primary"]).alias("k"), i.alias("i"), s.alias("s")))), lambda x: x["s"]),
        "comparisons": F.transform(F.array_sort(F.transform("comparisons", lambda c, i: F.struct(
            (-c["similarity"]).alias("k"), i.alias("i"), c.alias("c")))), lambda x: x["c"]),
    })


def view(published: DataFrame) -> DataFrame:
    """The published view model."""
    d = F.coalesce("item_published_at", "created_at")
    primary = F.coalesce(F.get(F.filter("sources", lambda s: s["is_primary"]), 0)["url"],
                         F.get(F.col("sources"), 0)["url"], F.col("item_url"))
    return published.select(
        "article_id", "title", "what_changed", "why_it_matters", "comparison", "scope_tags",
        "sources", "comparisons", "engine",
        d.alias("date"),
        F.date_format(d, "MMM dd, yyyy").alias("date_display"),
        F.date_format(d, "yyyy-MM-dd").alias("date_iso"),
        F.concat(F.lit("posts/"), F.col("article_id").cast("string"), F.lit(".html")).alias("permalink"),
        F.coalesce("item_source_id", F.lit("")).alias("source"),
        primary.alias("primary_url"),
        F.coalesce("scope_tags", F.array().cast("array<string>")).alias("tags"))


BLOCKS = "array<struct<type:string,text:string,items:array<string>>>"


def text_blocks(text) -> Column:
    """Lines -> array<struct<type, text, items>>; a run of '- ' lines is one ``list``
    block, other non-blank lines are ``paragraph`` blocks, a blank line closes a list."""
    lines = F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"\R")
    none = F.array().cast("array<string>")
    init = F.struct(F.array().cast(BLOCKS).alias("blocks"), none.alias("bullets"))

    def block(kind: str, text: Column, items: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), items.alias("items"))

    def flushed(acc):
        return F.when(F.size(acc["bullets"]) > 0, F.array_append(
            acc["blocks"], block("list", F.lit(""), acc["bullets"]))).otherwise(acc["blocks"])

    def step(acc, line):
        s = strip_ws(line)
        return (F.when(s == "", F.struct(flushed(acc).alias("blocks"), none.alias("bullets")))
                .when(s.startswith("- "), F.struct(acc["blocks"].alias("blocks"), F.array_append(
                    acc["bullets"], strip_ws(F.substring(s, 3, 1 << 30))).alias("bullets")))
                .otherwise(F.struct(F.array_append(flushed(acc), block("paragraph", s, none)).alias("blocks"),
                                    none.alias("bullets"))))
    return F.aggregate(lines, init, step, flushed)


def shown_blocks(blocks: Column) -> Column:
    """Blocks as lines: ``P:<text>`` or ``L:<item>|<item>``."""
    return F.array_join(F.transform(blocks, lambda b: F.when(b["type"] == "list", F.concat(
        F.lit("L:"), F.array_join(b["items"], "|"))).otherwise(F.concat(F.lit("P:"), b["text"]))), "\n")


def facets(v: DataFrame) -> DataFrame:
    """(facet, value) for distinct non-empty sources and distinct tags, plus
    the site statistics (posts, sources, tags)."""
    sources = v.where(F.col("source") != "").select(F.lit("source").alias("facet"),
                                                     F.col("source").alias("value")).distinct()
    tags = v.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value")).distinct()
    stats = v.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("sources"))
    ntags = tags.agg(F.count(F.lit(1)).alias("tags"))
    st = stats.crossJoin(ntags).select(F.explode(F.array(
        F.struct(F.lit("posts").alias("facet"), F.col("posts").cast("string").alias("value")),
        F.struct(F.lit("sources").alias("facet"), F.col("sources").cast("string").alias("value")),
        F.struct(F.lit("tags").alias("facet"), F.col("tags").cast("string").alias("value")))).alias("s")
    ).select("s.*")
    return sources.unionByName(tags).unionByName(st)


def search_text() -> Column:
    """P23."""
    return F.lower(F.concat_ws(" ", "title", "what_changed", "why_it_matters"))


def archive_search(v: DataFrame, q: str = "", source: str = "", tag: str = "",
                   month: str = "") -> DataFrame:
    """every given facet constrains, an empty one does not."""
    cond = F.lit(True)
    qq = (q or "").strip().lower()
    if qq:
        cond = cond & search_text().contains(qq)
    if source:
        cond = cond & (F.col("source") == source)
    if tag:
        cond = cond & F.array_contains("tags", tag)
    if month:
        cond = cond & F.col("date_iso").startswith(month)
    return v.where(cond)


def search_index(v: DataFrame) -> DataFrame:
    """S12 rows: id, title, url, date, source, tags, text."""
    return v.select(F.col("article_id").alias("id"), "title", F.col("permalink").alias("url"),
                    F.coalesce("date_iso", F.lit("")).alias("date"), "source", "tags",
                    search_text().alias("text"))


def json_feed_items(v: DataFrame, base_url: str = "", limit: int = FEED_LIMIT) -> DataFrame:
    """S14 items (first ``limit`` posts in publication order)."""
    top = v.orderBy(F.desc("date"), F.desc("article_id")).limit(limit)
    return top.select(
        F.col("article_id").cast("string").alias("id"),
        abs_url(F.col("permalink"), base_url).alias("url"),
        "title",
        strip_ws(F.concat(F.coalesce("what_changed", F.lit("")), F.lit("\n\n"),
                          F.coalesce("why_it_matters", F.lit("")))).alias("content_text"),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("date_published"),
        "tags", "date", "article_id")


def json_feed(items: DataFrame, title: str, description: str, base_url: str = "") -> DataFrame:
    """One-row frame with the JSON Feed 1.1 document (NULL dates kept)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros("date")).alias("k"), (-F.col("article_id")).alias("k2"),
        F.struct("id", "url", "title", "content_text", "date_published", "tags").alias("item")))),
        lambda x: x["item"])
    doc = items.agg(ordered.alias("items")).select(F.to_json(F.struct(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.lit(title).alias("title"),
        F.lit(description).alias("description"),
        F.lit(f"{base_url.rstrip('/')}/index.html" if base_url else "index.html").alias("home_page_url"),
        F.lit(f"{base_url.rstrip('/')}/feed.json" if base_url else "feed.json").alias("feed_url"),
        F.col("items")), {"ignoreNullFields": "false"}).alias("value"))
    return doc


def rss_items(v: DataFrame, base_url: str = "", limit: int = FEED_LIMIT,
              guid_prefix: str = "post-") -> DataFrame:
    """S13 <item> elements (first ``limit`` posts in publication order)."""
    top = v.orderBy(F.desc("date"), F.desc("article_id")).limit(limit)
    link = abs_url(F.col("permalink"), base_url)
    pub = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss Z")
    cats = F.array_join(F.transform("tags", lambda t: F.concat(
        F.lit("<category>"), xml_escape(t), F.lit("</category>"))), "")
    item = F.concat(
        F.lit("<item><title>"), xml_escape("title"), F.lit("</title><link>"), xml_escape(link),
        F.lit('</link><guid isPermaLink="false">' + guid_prefix), F.col("article_id").cast("string"),
        F.lit("</guid>"),
        F.when(F.col("date").isNotNull(), F.concat(F.lit("<pubDate>"), pub, F.lit("</pubDate>")))
        .otherwise(F.lit("")),
        F.lit("<description>"), xml_escape("what_changed"), F.lit("</description>"), cats,
        F.lit("</item>"))
    return top.select("article_id", "date", item.alias("item"))


def similarity_display(c) -> Column:
    """Two decimals, half up on the four that are reported."""
    return F.format_string("%.2f", F.floor((F.round(c * 10000) + 50) / 100) / 100)


def teasers(v: DataFrame) -> DataFrame:
    return v.select("article_id", teaser(F.col("what_changed")).alias("teaser"))
