"""Queries for page content, sentences and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.catalog.shared import THRESHOLD, TOP_K, related_items, relevant_items, written_pairs
from curata.functions.text import scored_sentences, sentences
from curata.functions.urls import with_identity
from curata.oracle import sql as O
from curata.operators.summarize import best_text, extracted, extractive, prompts
from curata.plans.generation import with_related, with_related_texts
from curata.scope import TEST_SCOPE
from curata.sources.archive import build_content_cache, with_cached_content
from curata.sources.items import page_items
from curata.sources.pages import page_text
from curata.sources.tables import read_table

# DuckDB: relevant items with their top-k related priors as a list of structs
RELATED_CTE = f"""{O.doc_items_cte()}, {O.scored_cte(TEST_SCOPE)},
rel AS (SELECT * FROM scored WHERE relevant),
toks AS (SELECT item_id, unnest({O.tokens(O.doc_text('title', 'summary'))}) AS term FROM rel),
tf AS (SELECT item_id, term, count(*) AS tf FROM toks GROUP BY item_id, term),
nd AS (SELECT count(DISTINCT item_id) AS n_docs FROM tf),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.item_id, tf.term, tf.tf * (ln((n_docs + 1.0) / (df + 1.0)) + 1.0) AS w
      FROM tf JOIN dfs USING (term), nd),
norms AS (SELECT item_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY item_id),
dots AS (SELECT a.item_id, b.item_id AS related_item_id, sum(a.w * b.w) AS dot
         FROM w a JOIN w b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2),
sims AS (SELECT d.item_id, d.related_item_id, d.dot / (na.nrm * nb.nrm) AS sim
         FROM dots d JOIN norms na ON na.item_id = d.item_id JOIN norms nb ON nb.item_id = d.related_item_id
         WHERE d.dot / (na.nrm * nb.nrm) >= {THRESHOLD}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 10) DESC, related_item_id) AS rank
           FROM sims),
relp AS (SELECT r.item_id, list({{'related_item_id': r.related_item_id, 'related_title': p.title,
                                  'related_url': p.url, 'related_summary': p.summary,
                                  'similarity': round(r.sim, 4)}} ORDER BY r.rank) AS related
         FROM ranked r JOIN rel p ON p.item_id = r.related_item_id WHERE r.rank <= {TOP_K} GROUP BY r.item_id),
inp AS (SELECT rel.*, coalesce(relp.related, []) AS related FROM rel LEFT JOIN relp USING (item_id))"""


def summary_inputs(spark, sf_dir):
    rel = relevant_items(spark, sf_dir)
    # of content and summary the one that is used
    own = rel.select("item_id", "title", "url", best_text().alias("content"), F.lit("").alias("summary"))
    return with_related_texts(own, written_pairs(spark, sf_dir), rel)


@register("page_text", f"SELECT page_id, {O.page_text('html')} AS text FROM pages")
def page_text_q(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", page_text("html").alias("text"))


@register("content_cache", f"""
WITH {O.page_items_cte()},
keyed AS (SELECT *, sha1({O.normalize_url('url')}) AS url_fp FROM page_items),
cache AS (SELECT url_fp, arg_min(content, item_id) AS content FROM keyed
          WHERE item_id % 2 = 0 AND content <> '' GROUP BY url_fp)
SELECT k.item_id, k.url_fp, CAST(coalesce(length(c.content), 0) AS INTEGER) AS content_chars
FROM keyed k LEFT JOIN cache c USING (url_fp)""")
def content_cache_q(spark, sf_dir):
    items = with_identity(page_items(spark, sf_dir))
    landed = items.where(F.col("item_id") % 2 == 0)   # the landed pages themselves, not the copies
    cache = build_content_cache(landed)
    out = with_cached_content(items.drop("content"), cache)
    return out.select("item_id", "url_fp",
                      F.coalesce(F.length("content"), F.lit(0)).alias("content_chars"))


@register("sentences", f"""
WITH s AS (SELECT doc_id, {O.sentences('text')} AS sents FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, sents[i] AS sentence
FROM s, range(1, len(s.sents) + 1) r(i)""")
def sentences_q(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(sentences("text")).alias("idx", "sentence"))


@register("sentence_scores", f"""
WITH s AS (SELECT doc_id, {O.sentences('text')} AS sents FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, {O.sentence_score('sents[i]', 'i - 1')} AS score
FROM s, range(1, len(s.sents) + 1) r(i)""")
def sentence_scores_q(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.explode(scored_sentences("text")).alias("s")).select(
        "doc_id", F.col("s.idx").alias("idx"), F.col("s.score").alias("score"))


@register("extractive_summary", f"""
WITH {RELATED_CTE},
p AS (SELECT *, {O.top_sentences_list(O.sentences(O.best_text()))} AS picked FROM inp)
SELECT item_id,
       CASE WHEN len(picked) > 0 THEN array_to_string(picked, ' ')
            WHEN coalesce(summary, '') <> '' THEN summary ELSE coalesce(title, '') END AS what_changed,
       CASE WHEN len(related) > 0 THEN 'Related prior coverage to compare against:' || chr(10)
              || array_to_string(list_transform(related, lambda r: '- ' || r.related_title), chr(10))
            ELSE '' END AS comparison
FROM p""")
def extractive_summary_q(spark, sf_dir):
    own = extracted(relevant_items(spark, sf_dir)).select("item_id", "what_changed")   # no text is shuffled
    inputs = with_related(own, related_items(spark, sf_dir).drop("related_summary"))
    return extractive(inputs, TEST_SCOPE.name).select(
        "item_id", "what_changed", "comparison")


def _prompt_sql() -> str:
    rel_line = ("lambda r: '- ' || r.related_title || CASE WHEN coalesce(r.related_summary, '') <> '' "
                "THEN ' — ' || r.related_summary ELSE '' END")
    return f"""
WITH {RELATED_CTE}
SELECT item_id,
  'TITLE: ' || title || chr(10) || 'SOURCE URL: ' || url
  || {O.q(chr(10) + 'BLOG FOCUS: ' + TEST_SCOPE.name)}
  || CASE WHEN {O.best_text()} <> '' THEN chr(10) || chr(10) || 'SOURCE TEXT:' || chr(10)
          || {O.best_text()} ELSE '' END
  || CASE WHEN len(related) > 0 THEN chr(10) || chr(10) || 'RELATED PRIOR ITEMS (for the comparison section):'
          || chr(10) || array_to_string(list_transform(related, {rel_line}), chr(10))
          ELSE chr(10) || chr(10) || 'RELATED PRIOR ITEMS: none' END AS prompt
FROM inp"""


@register("prompt_table", _prompt_sql())
def prompt_table_q(spark, sf_dir):
    return prompts(summary_inputs(spark, sf_dir), TEST_SCOPE.name)
