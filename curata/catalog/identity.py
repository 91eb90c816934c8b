"""Queries for item identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.functions.text import normalize_title, strip_html
from curata.functions.urls import normalize_url
from curata.oracle import sql as O
from curata.sources.items import document_items, page_items
from curata.sources.tables import read_table


def _all_items(spark, sf_dir):
    cols = ["item_id", "url", "title"]
    return document_items(spark, sf_dir).select(*cols).unionByName(
        page_items(spark, sf_dir).select(*cols))


_ALL_ITEMS = f"""{O.doc_items_cte()}, {O.page_items_cte()},
all_items AS (SELECT item_id, url, title FROM items UNION ALL SELECT item_id, url, title FROM page_items)"""


@register("normalize_url", f"""
WITH {_ALL_ITEMS}
SELECT item_id, url, {O.normalize_url('url')} AS normalized_url FROM all_items""")
def normalize_url_q(spark, sf_dir):
    return _all_items(spark, sf_dir).select("item_id", "url", normalize_url("url").alias("normalized_url"))


@register("normalize_title", f"""
WITH {_ALL_ITEMS}
SELECT item_id, title, {O.normalize_title('title')} AS normalized_title FROM all_items""")
def normalize_title_q(spark, sf_dir):
    return _all_items(spark, sf_dir).select("item_id", "title",
                                            normalize_title("title").alias("normalized_title"))


@register("fingerprints", f"""
WITH {_ALL_ITEMS}
SELECT item_id, sha1({O.normalize_url('url')}) AS url_fp,
       sha1({O.normalize_title('title')}) AS title_fp,
       CASE WHEN {O.normalize_title('title')} <> '' THEN sha1({O.normalize_title('title')}) END AS title_key
FROM all_items""")
def fingerprints_q(spark, sf_dir):
    nt = normalize_title("title")
    return _all_items(spark, sf_dir).select(
        "item_id", F.sha1(normalize_url("url")).alias("url_fp"), F.sha1(nt).alias("title_fp"),
        F.when(nt != "", F.sha1(nt)).alias("title_key"))


@register("strip_html", f"""
SELECT page_id, {O.strip_html('html')} AS text FROM pages""")
def strip_html_q(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", strip_html("html").alias("text"))
