"""Item tables derived from the driver tables.

There is no news table among the inputs, so news items are derived, by Spark,
from ``documents`` (prose) and ``pages`` (HTML). Every rule here has a twin in
``curata.oracle.sql`` so the DuckDB oracle sees the same items.

``items`` schema: item_id bigint, seq bigint, run_id bigint, source_id string,
url string, title string, summary string, content string, author string,
published_at timestamp, source_weight double, lang string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.text import collapse_ws, sentences, strip_html
from curata.sources.pages import page_text
from curata.sources.tables import read_table

EPOCH = "2024-01-01 00:00:00"


def _hours_after(count: str):
    """EPOCH plus so many hours (long arithmetic, so any id fits)."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.col(count) * 3600)


def document_summary(text):
    """The summary of a document's item, from its text (the item's content)."""
    return collapse_ws(text)


def items_from_documents(documents: DataFrame) -> DataFrame:
    """One item per document. The run (day) of an item is its hour offset // 24."""
    t = document_summary("text")
    # the first sentence: up to the first . ! or ? followed by white space
    first = F.regexp_extract(t, r"^(.*?[.!?]) ", 1)
    first = F.when(first != "", first).otherwise(t)
    return documents.select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("seq"),
        F.floor(F.col("doc_id") / 24).cast("bigint").alias("run_id"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.org/"), F.col("lang"),
                 F.lit("/"), F.col("doc_id"), F.lit("/?utm_source=feed&id="),
                 F.col("doc_id")).alias("url"),
        first.alias("title"),
        t.alias("summary"),
        F.col("text").alias("content"),
        F.lit("").alias("author"),
        _hours_after("doc_id").alias("fetched_at"),
        F.when(F.col("doc_id") % 10 != 0, _hours_after("doc_id")).alias("published_at"),
        ((F.col("doc_id") % 4) * 0.5).cast("double").alias("source_weight"),
        F.col("lang"),
    )


def mixed_batch(items: DataFrame) -> DataFrame:
    """The documents items plus a re-syndicated copy of every item whose text has a
    second sentence: same URL, the second sentence as headline, another weight and the
    next position (originals have even, copies odd ``seq``). URL and title collisions
    interlock (leader dedup input)."""
    # the second sentence: after the first boundary, up to the next one or the end
    second = F.nullif(F.regexp_extract(collapse_ws("content"), r"^.*?[.!?] (.*?[.!?](?= )|.+$)", 1),
                      F.lit(""))
    copies = (items.where(second.isNotNull())
              .withColumn("title", second)
              .withColumn("source_weight", (((F.col("item_id") + 2) % 4) * 0.5).cast("double"))
              .withColumn("seq", F.col("item_id") * 2 + 1))
    return items.withColumn("seq", F.col("item_id") * 2).unionByName(copies)


def _host(url):
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def items_from_pages(pages: DataFrame) -> DataFrame:
    """One item per landed page plus a re-syndicated copy of every page whose
    id is a multiple of 3 (www toggled, a tracking parameter added, a suffix on the
    title): the copies are URL duplicates with other titles. Pages have even ids (twice the
    page's), copies odd ones."""
    title = strip_html(F.coalesce(
        F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")),
        F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    body = F.coalesce(page_text("html"), F.lit(""))
    base = pages.select(
        (F.col("page_id") * 2).alias("item_id"),
        (F.col("page_id") * 2).alias("seq"),
        F.floor(F.col("page_id") / 25).cast("bigint").alias("run_id"),
        _host(F.col("url")).alias("source_id"),
        F.col("url"),
        title.alias("title"),
        collapse_ws(body).alias("summary"),
        body.alias("content"),
        F.lit("").alias("author"),
        (F.to_timestamp(F.lit(EPOCH)) + F.make_interval(days=F.floor(F.col("page_id") / 25).cast("int"))
         ).alias("fetched_at"),
        F.lit(None).cast("timestamp").alias("published_at"),
        ((F.col("page_id") % 3) * 0.5).cast("double").alias("source_weight"),
        F.regexp_extract("html", r"<html[^>]*lang=\"([^\"]*)\"", 1).alias("lang"),
    )
    no_frag = F.regexp_replace("url", "#.*$", "")
    toggled = F.when(no_frag.rlike(r"^[A-Za-z]+://www\."),
                     F.regexp_replace(no_frag, r"^([A-Za-z]+://)www\.", "$1")
                     ).otherwise(F.regexp_replace(no_frag, r"^([A-Za-z]+://)", "$1www."))
    copy_url = F.concat(toggled, F.when(no_frag.contains("?"), F.lit("&")).otherwise(F.lit("?")),
                        F.lit("utm_medium=social"))
    copies = (base.where(F.col("item_id") % 6 == 0)
              .withColumn("url", copy_url)
              .withColumn("title", F.concat(F.col("title"), F.lit(" | Digest")))
              .withColumn("source_weight", (((F.col("item_id") / 2 + 1).cast("bigint") % 4) * 0.5).cast("double"))
              .withColumn("seq", F.col("seq") + 1)
              .withColumn("item_id", F.col("item_id") + 1)
              .withColumn("source_id", F.lit("aggregator")))
    return base.unionByName(copies)


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived where they are read, so each query's columns and filters reach the scan."""
    return items_from_documents(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_from_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
