"""Queries over daily runs and published documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curata.catalog import register
from curata.catalog.articles import GEN_SQL, _answers_sql
from curata.catalog.feeds import _counts_sql, _discovered_sql
from curata.catalog.publication import BASE_URL, PUB_SQL
from curata.catalog.shared import CREATED_AT, MAX_WORDS, MIN_WORDS, THRESHOLD, TOP_K, article_store, once
from curata.functions.urls import with_identity
from curata.oracle import sql as O
from curata.plans.daily import run_daily, run_status
from curata.plans.publication import publish
from curata.scope import TEST_SCOPE
from curata.session import ensure_checkpoint_dir, stored
from curata.sources.archive import build_content_cache, read_items, write_items
from curata.sources.items import document_items, page_items

LIMIT = 50
SITE = ("News & more", "What changed")


def _daily_sql() -> str:
    """DuckDB: two daily runs over the page items. The second finds everything archived and
    writes the next articles of the queue."""
    discovered = f"""{O.page_items_cte('landed')}, {O.scored_cte(TEST_SCOPE, 'landed', 'seen')},
{_discovered_sql('seen', 'day_one', None)}, {_discovered_sql('seen', 'day_two', 'day_one_stored')},
cache AS (SELECT url_fp, arg_min(content, item_id) AS content FROM day_one WHERE content <> '' GROUP BY url_fp),
items AS (SELECT CAST(row_number() OVER (ORDER BY CASE WHEN batch_dup THEN 1 ELSE 0 END, place, seq) AS BIGINT) AS item_id,
                 source_id, url, title, summary, c.content, published_at, fetched_at, source_weight, batch_dup AS dup
          FROM day_one_stored LEFT JOIN cache c USING (url_fp))"""
    sql = GEN_SQL.replace(O.doc_items_cte(), discovered).replace(
        "rel AS (SELECT * FROM scored WHERE relevant)", "rel AS (SELECT * FROM scored WHERE relevant AND NOT dup)")
    none = "ans AS (SELECT NULL::BIGINT AS item_id, NULL::VARCHAR AS stop_reason, NULL::VARCHAR AS text WHERE false)"
    return f"""{sql.replace(_answers_sql(), none)},
queue AS (SELECT r.item_id, fetched_at, r.content IS NOT NULL AS has_content,
                 row_number() OVER (ORDER BY coalesce(published_at, fetched_at) DESC, r.item_id DESC) AS n FROM rel r),
days AS (SELECT 1 AS run_id, 0 AS after UNION ALL SELECT 2, {LIMIT}),
made AS (SELECT d.run_id, count(q.item_id) AS considered, count(a.item_id) AS generated,
                count(*) FILTER (a.quality_status = 'pass') AS passed, count(*) FILTER (q.has_content) AS content_fetched,
                (SELECT count(*) FROM queue JOIN articles USING (item_id)
                 WHERE n <= d.after + {LIMIT} AND quality_status = 'pass') AS posts
         FROM days d LEFT JOIN queue q ON q.n > d.after AND q.n <= d.after + {LIMIT}
         LEFT JOIN articles a USING (item_id) GROUP BY d.run_id, d.after),
found AS ({_counts_sql(1, 'day_one')} UNION ALL {_counts_sql(2, 'day_two')})"""


@register("run_status", f"""WITH {_daily_sql()}
SELECT run_id, true AS ok, fetched, duplicates, relevant, inserted, considered, generated, passed, content_fetched, posts,
       CASE WHEN relevant = 0 AND generated = 0 THEN 'empty_news' ELSE 'ok' END AS status,
       CASE WHEN relevant = 0 AND generated = 0 THEN 'no relevant news and no new articles today'
            ELSE 'published/updated ' || generated || ' article(s) from ' || relevant || ' relevant item(s)' END AS summary
FROM found JOIN made USING (run_id)""")
def run_status_q(spark, sf_dir):
    """Two whole daily runs over the page items: discovery, generation (a queue of 50), feeds,
    status row; the second one meets the archive of the first."""
    def make(root):
        # written once: both runs read the items and the cache several times, and each reading
        # would extract the pages' texts again
        batch = stored(page_items(spark, sf_dir), "landed-items")
        landed = stored(build_content_cache(with_identity(batch)), "landed-texts")
        for run in (1, 2):
            run_daily(batch.drop("content"), landed, root, TEST_SCOPE, run, CREATED_AT, LIMIT, base_url=BASE_URL,
                      top_k=TOP_K, min_similarity=THRESHOLD, min_words=MIN_WORDS, max_words=MAX_WORDS)
        return root
    root = once(spark, sf_dir, "daily-runs", make)
    stat = lambda of, *names: [F.coalesce(F.col(of)[n], F.lit(0)).alias(n) for n in names]
    return run_status(spark, root).select(
        "run_id", "ok", *stat("discovery", "fetched", "duplicates", "relevant", "inserted"),
        *stat("generation", "considered", "generated", "passed", "content_fetched"), *stat("site", "posts"),
        F.col("health.status").alias("status"), F.col("health.summary").alias("summary"))


# ------------------------------------------------------------------ published documents
def _site(spark, sf_dir) -> str:
    def make(path):
        publish(article_store(spark, sf_dir), document_items(spark, sf_dir), path, *SITE, CREATED_AT, BASE_URL)
        return path
    return once(spark, sf_dir, "site", make)


_ITEM = f"""'<item><title>' || {O.xml_escape('title')} || '</title><link>' || {O.xml_escape(f"'{BASE_URL}/' || permalink")}
  || '</link><guid isPermaLink="false">post-' || CAST(article_id AS VARCHAR) || '</guid><pubDate>'
  || strftime(date, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate><description>' || {O.xml_escape('what_changed')} || '</description>'
  || array_to_string(list_transform(tags, lambda t: '<category>' || {O.xml_escape('t')} || '</category>'), '') || '</item>'"""


@register("rss_document", f"""WITH {PUB_SQL},
newest AS (SELECT * FROM v ORDER BY date DESC, article_id DESC LIMIT 50)
SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"><channel><title>News &amp; more</title><link>{BASE_URL}'
  || '</link><description>What changed</description><lastBuildDate>'
  || strftime(TIMESTAMP '{CREATED_AT}', '%a, %d %b %Y %H:%M:%S +0000') || '</lastBuildDate>'
  || coalesce(string_agg({_ITEM}, '' ORDER BY date DESC, article_id DESC), '') || '</channel></rss>' || chr(10) AS value FROM newest""")
def rss_document_q(spark, sf_dir):
    """feed.xml as written, read back."""
    return spark.read.text(f"{_site(spark, sf_dir)}/feed.xml", wholetext=True)


@register("json_feed_document", f"""WITH {PUB_SQL},
newest AS (SELECT *, row_number() OVER (ORDER BY date DESC, article_id DESC) AS n FROM v)
SELECT 'https://jsonfeed.org/version/1.1' AS version, 'News & more' AS title, 'What changed' AS description,
       '{BASE_URL}/index.html' AS home_page_url, '{BASE_URL}/feed.json' AS feed_url, CAST(n - 1 AS INTEGER) AS place,
       CAST(article_id AS VARCHAR) AS id, '{BASE_URL}/' || permalink AS url, title AS item_title,
       {O.strip_ws("coalesce(what_changed, '') || chr(10) || chr(10) || coalesce(why_it_matters, '')")} AS content_text,
       strftime(date, '%Y-%m-%dT%H:%M:%S+00:00') AS date_published, array_to_string(tags, '|') AS tags
FROM newest WHERE n <= 50""")
def json_feed_document_q(spark, sf_dir):
    """feed.json as written, read back and taken apart."""
    schema = ("version string, title string, description string, home_page_url string, feed_url string, items array<struct<"
              "id:string,url:string,title:string,content_text:string,date_published:string,tags:array<string>>>")
    doc = spark.read.text(f"{_site(spark, sf_dir)}/feed.json", wholetext=True).select(F.from_json("value", schema).alias("d"))
    head = [F.col(f"d.{c}").alias(c) for c in ("version", "title", "description", "home_page_url", "feed_url")]
    return doc.select(*head, F.posexplode("d.items").alias("place", "item")).select(
        "version", "title", "description", "home_page_url", "feed_url", "place", "item.id", "item.url",
        F.col("item.title").alias("item_title"), "item.content_text", "item.date_published",
        F.array_join("item.tags", "|").alias("tags"))


@register("search_document", f"""WITH {PUB_SQL}
SELECT CAST(article_id AS BIGINT) AS id, title, permalink AS url, coalesce(date_iso, '') AS date, source,
       array_to_string(tags, '|') AS tags, lower(concat_ws(' ', title, what_changed, why_it_matters)) AS text FROM v""")
def search_document_q(spark, sf_dir):
    """search.json as written, read back."""
    schema = "id bigint, title string, url string, date string, source string, tags array<string>, text string"
    return spark.read.schema(schema).json(f"{_site(spark, sf_dir)}/search.json").withColumn("tags", F.array_join("tags", "|"))


# ------------------------------------------------------------------ schema versions
@register("schema_evolution", f"""WITH {O.doc_items_cte()}
SELECT item_id, run_id, title, CASE WHEN run_id % 2 = 0 THEN '' ELSE content END AS content,
       CASE WHEN run_id % 2 = 0 THEN NULL ELSE strftime(fetched_at, '%Y-%m-%d %H:%M:%S') END AS content_fetched_at
FROM items""")
def schema_evolution_q(spark, sf_dir):
    """One archive, files of two schema versions: even runs are written without the columns that
    came later and read back with their defaults."""
    def make(path):
        items = with_identity(document_items(spark, sf_dir))
        write_items(items.where(F.col("run_id") % 2 == 0).drop("content"), path, version=1)
        write_items(items.where(F.col("run_id") % 2 != 0).withColumn("content_fetched_at", F.col("fetched_at")), path)
        return path
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/schema-versions-{uuid.uuid4().hex}"
    return read_items(spark, make(path)).select(
        "item_id", "run_id", "title", "content",
        F.date_format("content_fetched_at", "yyyy-MM-dd HH:mm:ss").alias("content_fetched_at"))
