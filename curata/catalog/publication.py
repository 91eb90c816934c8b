"""Queries for publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.catalog.articles import GEN_SQL
from curata.catalog.shared import CREATED_AT, article_store
from curata.oracle import sql as O
from curata.operators.publish import (archive_search, facets, json_feed_items, rss_items,
                                      search_index, shown_blocks, similarity_display, teasers, text_blocks)
from curata.plans import publication
from curata.sources.items import document_items

BASE_URL = "https://news.example.org"
SEARCH = dict(q="The", tag="tion")


def published_view(spark, sf_dir):
    return publication.published_view(article_store(spark, sf_dir), document_items(spark, sf_dir))


PUB_SQL = f"""{GEN_SQL},
arts AS (SELECT row_number() OVER (ORDER BY item_id) AS article_id, *,
                TIMESTAMP '{CREATED_AT}' AS created_at FROM articles),
pub AS (SELECT a.*, i.published_at AS item_published_at, i.source_id AS item_source_id, i.url AS item_url
        FROM arts a JOIN items i USING (item_id) WHERE a.quality_status = 'pass'),
v AS (SELECT article_id, title, what_changed, why_it_matters, comparison, related,
             coalesce(item_published_at, created_at) AS date,
             strftime(coalesce(item_published_at, created_at), '%Y-%m-%d') AS date_iso,
             'posts/' || CAST(article_id AS VARCHAR) || '.html' AS permalink,
             coalesce(item_source_id, '') AS source, url AS primary_url, scope_tags AS tags
      FROM pub)"""


@register("published_articles", f"""WITH {PUB_SQL}
SELECT CAST(article_id AS BIGINT) AS article_id, title, date_iso, source, primary_url,
       array_to_string(tags, '|') AS tags, CAST(len(related) AS INTEGER) AS n_comparisons FROM v""")
def published_articles_q(spark, sf_dir):
    return published_view(spark, sf_dir).select(
        "article_id", "title", "date_iso", "source", "primary_url",
        F.array_join("tags", "|").alias("tags"), F.size("comparisons").alias("n_comparisons"))


@register("article_children", f"""WITH {GEN_SQL},
arts AS (SELECT row_number() OVER (ORDER BY item_id) AS article_id, * FROM articles)
SELECT CAST(article_id AS BIGINT) AS article_id,
       source_id || '|' || url || '|true' AS sources,
       array_to_string(list_transform(related, lambda c: CAST(c.related_item_id AS VARCHAR) || '@'
         || printf('%.2f', floor((round(c.similarity * 10000) + 50) / 100) / 100)), ';') AS comparisons
FROM arts""")
def article_children_q(spark, sf_dir):
    arts = article_store(spark, sf_dir).with_children()
    return arts.select(
        "article_id",
        F.array_join(F.transform("sources", lambda s: F.concat_ws(
            "|", s["source_id"], s["url"], s["is_primary"].cast("string"))), ";").alias("sources"),
        F.array_join(F.transform("comparisons", lambda c: F.concat(
            c["related_item_id"].cast("string"), F.lit("@"), similarity_display(c["similarity"]))), ";"
        ).alias("comparisons"))


def _blocks_sql(e: str) -> str:
    flush = ("CASE WHEN len(acc.bullets) > 0 THEN list_append(acc.blocks, 'L:' || array_to_string(acc.bullets, '|'))"
             " ELSE acc.blocks END")
    s = O.strip_ws("x")
    step = (f"CASE WHEN {s} = '' THEN {{'blocks': {flush}, 'bullets': []::VARCHAR[]}}"
            f" WHEN starts_with({s}, '- ') THEN {{'blocks': acc.blocks, 'bullets': list_append(acc.bullets, "
            f"{O.strip_ws(f'substring({s}, 3)')})}}"
            f" ELSE {{'blocks': list_append({flush}, 'P:' || {s}), 'bullets': []::VARCHAR[]}} END")
    red = (f"list_reduce(string_split(coalesce({e}, ''), chr(10)), lambda acc, x: {step},"
           f" {{'blocks': []::VARCHAR[], 'bullets': []::VARCHAR[]}})")
    return f"list_transform([{red}], lambda acc: array_to_string({flush}, chr(10)))[1]"


@register("text_blocks", f"""WITH {GEN_SQL},
arts AS (SELECT row_number() OVER (ORDER BY item_id) AS article_id, * FROM articles)
SELECT CAST(article_id AS BIGINT) AS article_id, {_blocks_sql('what_changed')} AS what_blocks,
       {_blocks_sql('comparison')} AS comparison_blocks FROM arts""")
def text_blocks_q(spark, sf_dir):
    arts = article_store(spark, sf_dir).articles()
    return arts.select("article_id",
                       shown_blocks(text_blocks("what_changed")).alias("what_blocks"),
                       shown_blocks(text_blocks("comparison")).alias("comparison_blocks"))


@register("facets", f"""WITH {PUB_SQL},
src AS (SELECT DISTINCT 'source' AS facet, source AS value FROM v WHERE source <> ''),
tg AS (SELECT DISTINCT 'tag' AS facet, unnest(tags) AS value FROM v)
SELECT * FROM src UNION ALL SELECT * FROM tg
UNION ALL SELECT 'posts', CAST(count(*) AS VARCHAR) FROM v
UNION ALL SELECT 'sources', CAST(count(DISTINCT CASE WHEN source <> '' THEN source END) AS VARCHAR) FROM v
UNION ALL SELECT 'tags', CAST(count(*) AS VARCHAR) FROM tg""")
def facets_q(spark, sf_dir):
    return facets(published_view(spark, sf_dir))


@register("archive_search", f"""WITH {PUB_SQL}
SELECT CAST(article_id AS BIGINT) AS article_id, title FROM v
WHERE contains(lower(concat_ws(' ', title, what_changed, why_it_matters)), {O.q(SEARCH['q'].strip().lower())})
  AND list_contains(tags, {O.q(SEARCH['tag'])})""")
def archive_search_q(spark, sf_dir):
    return archive_search(published_view(spark, sf_dir), **SEARCH).select("article_id", "title")


@register("search_index", f"""WITH {PUB_SQL}
SELECT CAST(article_id AS BIGINT) AS id, title, permalink AS url, coalesce(date_iso, '') AS date, source,
       array_to_string(tags, '|') AS tags, lower(concat_ws(' ', title, what_changed, why_it_matters)) AS text
FROM v""")
def search_index_q(spark, sf_dir):
    return search_index(published_view(spark, sf_dir)).withColumn("tags", F.array_join("tags", "|"))


@register("json_feed_items", f"""WITH {PUB_SQL}
SELECT CAST(article_id AS VARCHAR) AS id, '{BASE_URL}/' || permalink AS url, title,
       {O.strip_ws("coalesce(what_changed, '') || chr(10) || chr(10) || coalesce(why_it_matters, '')")} AS content_text,
       strftime(date, '%Y-%m-%dT%H:%M:%S+00:00') AS date_published, array_to_string(tags, '|') AS tags
FROM v ORDER BY date DESC, article_id DESC LIMIT 50""")
def json_feed_items_q(spark, sf_dir):
    return json_feed_items(published_view(spark, sf_dir), BASE_URL).select(
        "id", "url", "title", "content_text", "date_published", F.array_join("tags", "|").alias("tags"))


@register("rss_items", f"""WITH {PUB_SQL}
SELECT CAST(article_id AS BIGINT) AS article_id,
  '<item><title>' || {O.xml_escape('title')} || '</title><link>' || {O.xml_escape(f"'{BASE_URL}/' || permalink")}
  || '</link><guid isPermaLink="false">post-' || CAST(article_id AS VARCHAR) || '</guid>'
  || CASE WHEN date IS NOT NULL THEN '<pubDate>' || strftime(date, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate>' ELSE '' END
  || '<description>' || {O.xml_escape('what_changed')} || '</description>'
  || array_to_string(list_transform(tags, lambda t: '<category>' || {O.xml_escape('t')} || '</category>'), '')
  || '</item>' AS item
FROM v ORDER BY date DESC, article_id DESC LIMIT 50""")
def rss_items_q(spark, sf_dir):
    return rss_items(published_view(spark, sf_dir), BASE_URL).select("article_id", "item")


@register("teaser", f"""WITH {PUB_SQL}
SELECT CAST(article_id AS BIGINT) AS article_id, {O.teaser('what_changed')} AS teaser FROM v""")
def teaser_q(spark, sf_dir):
    return teasers(published_view(spark, sf_dir))
