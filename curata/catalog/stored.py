"""Queries over the article store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curata.catalog import register
from curata.catalog.articles import GEN_SQL
from curata.catalog.shared import RUN_ID, article_store, drafts, relevant_items
from curata.operators.publish import similarity_display
from curata.operators.reports import QUALITY_STATUSES, status_counts
from curata.session import ensure_checkpoint_dir, passing, stored
from curata.sources.store import ArticleStore

#: DuckDB: the stored articles
STORED_SQL = f"""{GEN_SQL},
stored AS (SELECT CAST(row_number() OVER (ORDER BY item_id) AS BIGINT) AS article_id, * FROM articles)"""
COUNTERS = ("considered", "generated", "passed", "flagged", "failed_quality", "llm_fallbacks", "content_fetched")
LOOKED_UP = 7


def _counted(stats: str = "stats"):
    return [F.coalesce(F.col(stats)[c], F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]


@register("article_sources", f"""WITH {STORED_SQL}
SELECT article_id, CAST(0 AS INTEGER) AS position, url, title, source_id, true AS is_primary FROM stored""")
def article_sources_q(spark, sf_dir):
    return article_store(spark, sf_dir).sources().drop("run_id")


@register("article_comparisons", f"""WITH {STORED_SQL},
listed AS (SELECT article_id, related, unnest(range(len(related))) AS position FROM stored)
SELECT article_id, CAST(position AS INTEGER) AS position, related[position + 1].related_item_id AS related_item_id,
       related[position + 1].related_title AS related_title, related[position + 1].related_url AS related_url,
       related[position + 1].similarity AS similarity, '' AS note
FROM listed""")
def article_comparisons_q(spark, sf_dir):
    return article_store(spark, sf_dir).comparisons().drop("run_id")


@register("article_rerun", f"""WITH {STORED_SQL},
early AS (SELECT * FROM stored WHERE item_id % 2 = 0), late AS (SELECT * FROM stored WHERE item_id % 2 <> 0)
SELECT CAST(1 AS BIGINT) AS run_id, count(*) AS written, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id FROM early
UNION ALL SELECT 2, (SELECT count(*) FROM late), (SELECT count(*) + 1 FROM early), (SELECT count(*) FROM stored)
UNION ALL SELECT 3, 0, NULL, NULL""")
def article_rerun_q(spark, sf_dir):
    """A store of its own: run 1 brings the even items, run 2 all of them (only those without
    an article are written, with ids that go on), runs 1 and 3 bring all of them again."""
    store = ArticleStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/article-rerun-{uuid.uuid4().hex}")
    with passing(spark):
        every = stored(drafts(spark, sf_dir).drop("related"), "rerun-drafts")
        for run, rows in ((1, every.where(F.col("item_id") % 2 == 0)), (2, every), (1, every), (3, every)):
            store.append(rows, run, "2024-06-01 00:00:00")
    ids = store.articles().groupBy("run_id").agg(
        F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"))
    return store.commits().join(ids, "run_id", "left").select(
        "run_id", F.col("stats")["generated"].alias("written"), "first_id", "last_id")


@register("generation_report", f"""WITH {STORED_SQL}
SELECT CAST({RUN_ID} AS BIGINT) AS run_id, (SELECT count(*) FROM rel) AS considered, count(*) AS generated,
       count(*) FILTER (quality_status = 'pass') AS passed, count(*) FILTER (quality_status = 'flagged') AS flagged,
       count(*) FILTER (quality_status = 'fail') AS failed_quality,
       count(*) FILTER (engine = 'extractive') AS llm_fallbacks, CAST(0 AS BIGINT) AS content_fetched
FROM stored""")
def generation_report_q(spark, sf_dir):
    """The counters that the run took while it wrote its articles."""
    return article_store(spark, sf_dir).commits().select("run_id", *_counted())


@register("article_quality_counts", f"""WITH {STORED_SQL},
domain AS (SELECT unnest(['pass', 'flagged', 'fail']) AS status)
SELECT status, count(item_id) AS n FROM domain LEFT JOIN stored ON quality_status = status GROUP BY status
UNION ALL SELECT 'total', count(*) FROM stored""")
def article_quality_counts_q(spark, sf_dir):
    return status_counts(article_store(spark, sf_dir).articles(), "quality_status", QUALITY_STATUSES)


@register("article_by_id", f"""WITH {STORED_SQL}
SELECT article_id, item_id, title, quality_status, source_id || '|' || url AS sources,
       array_to_string(list_transform(related, lambda c: CAST(c.related_item_id AS VARCHAR) || '@'
         || printf('%.2f', floor((round(c.similarity * 10000) + 50) / 100) / 100)), ';') AS comparisons
FROM stored WHERE article_id = {LOOKED_UP}""")
def article_by_id_q(spark, sf_dir):
    return article_store(spark, sf_dir).article(LOOKED_UP).select(
        "article_id", "item_id", "title", "quality_status",
        F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["source_id"], s["url"])), ";").alias("sources"),
        F.array_join(F.transform("comparisons", lambda c: F.concat(
            c["related_item_id"].cast("string"), F.lit("@"), similarity_display(c["similarity"]))), ";").alias("comparisons"))


@register("recent_articles", f"""WITH {STORED_SQL}
SELECT article_id, item_id, title, quality_status FROM stored ORDER BY article_id DESC LIMIT 20""")
def recent_articles_q(spark, sf_dir):
    return article_store(spark, sf_dir).recent(20).select("article_id", "item_id", "title", "quality_status")


@register("priors_has_article", f"""WITH {GEN_SQL}
SELECT item_id, true AS has_article FROM rel WHERE item_id % 2 = 0
UNION ALL SELECT item_id, false FROM rel WHERE item_id % 2 <> 0""")
def priors_has_article_q(spark, sf_dir):
    """Every relevant item against a store that holds the articles of the even ones."""
    store = ArticleStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/article-half-{uuid.uuid4().hex}")
    store.append(drafts(spark, sf_dir).where(F.col("item_id") % 2 == 0), 1, "2024-06-01 00:00:00")
    return store.has_article(relevant_items(spark, sf_dir)).select("item_id", "has_article")
