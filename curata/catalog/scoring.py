"""Queries for relevance scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.oracle import sql as O
from curata.operators.relevance import apply_relevance, dictionary_hits, vocabulary
from curata.operators.reports import status_counts
from curata.operators.dedup import winners_by_key
from curata.functions.urls import with_identity
from curata.scope import RETARGET_SCOPE, SHIPPED_SCOPE, TEST_SCOPE
from curata.sources.items import document_items


def _scored(spark, sf_dir, scope=TEST_SCOPE):
    return apply_relevance(document_items(spark, sf_dir), scope)


@register("relevance_score", f"""
WITH {O.doc_items_cte()}, {O.scored_cte(TEST_SCOPE)}
SELECT item_id, relevance_score, relevant, status FROM scored""")
def relevance_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("item_id", "relevance_score", "relevant", "status")


@register("keyword_hits", f"""
WITH {O.doc_items_cte()}, {O.scored_cte(TEST_SCOPE)}
SELECT item_id,
       array_to_string(strong_hits, '|') AS strong_hits,
       array_to_string(normal_hits, '|') AS normal_hits,
       array_to_string(signal_hits, '|') AS signal_hits,
       array_to_string(exclude_hits, '|') AS exclude_hits
FROM scored""")
def keyword_hits(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "item_id", *[F.array_join(c, "|").alias(c)
                     for c in ("strong_hits", "normal_hits", "signal_hits", "exclude_hits")])


@register("relevance_reasons", f"""
WITH {O.doc_items_cte()}, {O.scored_cte(TEST_SCOPE)}
SELECT item_id, array_to_string(relevance_reasons, ' | ') AS reasons FROM scored""")
def relevance_reasons(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "item_id", F.array_join("relevance_reasons", " | ").alias("reasons"))


@register("relevance_retarget", f"""
WITH {O.doc_items_cte()}, {O.scored_cte(RETARGET_SCOPE)}
SELECT item_id, relevance_score, relevant, array_to_string(relevance_reasons, ' | ') AS reasons
FROM scored""")
def relevance_retarget(spark, sf_dir):
    return _scored(spark, sf_dir, RETARGET_SCOPE).select(
        "item_id", "relevance_score", "relevant",
        F.array_join("relevance_reasons", " | ").alias("reasons"))


@register("status_counts", f"""
WITH {O.doc_items_cte()}, {O.scored_cte(TEST_SCOPE)},
keyed AS (
  SELECT *, CASE WHEN {O.normalize_title('title')} <> '' THEN sha1({O.normalize_title('title')}) END AS title_key
  FROM scored),
ranked AS (
  SELECT *, CASE WHEN title_key IS NULL THEN 1 ELSE
           row_number() OVER (PARTITION BY title_key ORDER BY source_weight DESC, seq) END AS rn
  FROM keyed),
statused AS (
  SELECT CASE WHEN rn > 1 THEN 'duplicate' ELSE status END AS status FROM ranked),
domain(status) AS (VALUES ('new'), ('relevant'), ('irrelevant'), ('duplicate'))
SELECT d.status, CAST(count(s.status) AS BIGINT) AS n
FROM domain d LEFT JOIN statused s ON s.status = d.status GROUP BY d.status
UNION ALL
SELECT 'total' AS status, CAST(count(*) AS BIGINT) AS n FROM statused""")
def status_counts_q(spark, sf_dir):
    items = winners_by_key(with_identity(_scored(spark, sf_dir)), "title_key")
    items = items.withColumn("status", F.when(F.col("is_winner"), F.col("status"))
                             .otherwise(F.lit("duplicate")))
    return status_counts(items)


VOCABULARY = sorted({k for scope in (TEST_SCOPE, RETARGET_SCOPE, SHIPPED_SCOPE)
                     for k in (*scope.strong, *scope.normal, *scope.signals, *scope.exclude)})


@register("dictionary_hits", f"""WITH {O.doc_items_cte()},
found AS (SELECT item_id, unnest({O.keyword_hits(O.scoring_text('title', 'summary'), VOCABULARY)}) AS term FROM items)
SELECT item_id, term FROM found""")
def dictionary_hits_q(spark, sf_dir):
    """All terms of the three scopes as one vocabulary, matched by n-grams."""
    return dictionary_hits(document_items(spark, sf_dir), vocabulary(spark, VOCABULARY))
