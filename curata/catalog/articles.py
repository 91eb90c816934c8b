"""Queries for article generation.

Generation runs once over the whole relevant set (no queue limit), with model answers
derived from ``labels`` and related priors for every item, into the article store that
these queries read (``shared.py``); the work queue query keeps its
limit (the queue size is the feature) over the items that have no article yet.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.catalog.shared import MAX_WORDS, MIN_WORDS, article_store, relevant_items
from curata.catalog.summary import RELATED_CTE
from curata.oracle import sql as O
from curata.operators.quality import PLACEHOLDER_MARKERS
from curata.operators.relevance import apply_relevance, scope_tags
from curata.operators.summarize import DEFAULT_FOCUS  # noqa: F401
from curata.plans.generation import work_queue
from curata.scope import TEST_SCOPE
from curata.session import materialize
from curata.sources.items import document_items

WHY = (f"A concrete addition to {TEST_SCOPE.name}: it changes what's available to "
       f"builders today rather than being general commentary.")


def _answers_sql() -> str:
    return """ans AS (
  SELECT l.doc_id AS item_id,
         CASE WHEN l.toxic = 1 THEN 'refusal' ELSE 'end_turn' END AS stop_reason,
         CASE WHEN l.toxic = 1 THEN ''
              WHEN l.quality = 0 THEN '{"what_changed": "' || substring(i.title, 1, 20)
              ELSE CAST(json_object('what_changed', 'Model summary of item ' || CAST(i.item_id AS VARCHAR) || ': ' || i.title,
                                    'why_it_matters', 'It matters to readers of ' || i.source_id || '.',
                                    'comparison', '') AS VARCHAR) END AS text
  FROM labels l JOIN items i ON i.item_id = l.doc_id)"""


def _generation_sql() -> str:
    j = "CASE WHEN json_valid(a.text) THEN a.text ELSE '{}' END"
    valid = (f"coalesce(a.stop_reason <> 'refusal' AND json_valid(a.text)"
             f" AND json_extract_string({j}, '$.what_changed') IS NOT NULL"
             f" AND json_extract_string({j}, '$.why_it_matters') IS NOT NULL"
             f" AND json_extract_string({j}, '$.comparison') IS NOT NULL, false)")
    cmp_ext = ("CASE WHEN len(related) > 0 THEN 'Related prior coverage to compare against:' || chr(10)"
               " || array_to_string(list_transform(related, lambda r: '- ' || r.related_title), chr(10)) ELSE '' END")
    marker = "CASE " + " ".join(f"WHEN contains(lower(body), {O.q(m)}) THEN {O.q(m)}"
                                for m in PLACEHOLDER_MARKERS) + " END"
    quoted = "CASE " + " ".join(f"WHEN marker = {O.q(m)} THEN {O.q(repr(m))}"
                                for m in PLACEHOLDER_MARKERS) + " END"
    body = ("'# ' || coalesce(title, '') || chr(10) || chr(10) || '**What changed**' || chr(10) || chr(10)"
            " || coalesce(what_changed, '')"
            " || CASE WHEN coalesce(why_it_matters, '') <> '' THEN chr(10) || chr(10) || '**Why it matters**'"
            " || chr(10) || chr(10) || why_it_matters ELSE '' END"
            " || CASE WHEN coalesce(comparison, '') <> '' THEN chr(10) || chr(10) || '**How it compares**'"
            " || chr(10) || chr(10) || comparison ELSE '' END")
    return f"""{RELATED_CTE}, {_answers_sql()},
gen AS (
  SELECT inp.*, {valid} AS valid, a.text AS ans_text,
         {O.top_sentences_list(O.sentences(O.best_text()))} AS picked
  FROM inp LEFT JOIN ans a USING (item_id)),
drafts AS (
  SELECT item_id, title, url, source_id, summary, related, valid,
    CASE WHEN valid THEN {O.strip_ws("json_extract_string(ans_text, '$.what_changed')")}
         WHEN len(picked) > 0 THEN array_to_string(picked, ' ')
         WHEN coalesce(summary, '') <> '' THEN summary ELSE coalesce(title, '') END AS what_changed,
    CASE WHEN valid THEN {O.strip_ws("json_extract_string(ans_text, '$.why_it_matters')")}
         ELSE {O.q(WHY)} END AS why_it_matters,
    CASE WHEN valid THEN {O.strip_ws("json_extract_string(ans_text, '$.comparison')")}
         ELSE {cmp_ext} END AS comparison,
    CASE WHEN valid THEN 'llm' ELSE 'extractive' END AS engine,
    list_concat([{O.q(TEST_SCOPE.name)}]::VARCHAR[], list_slice(strong_hits, 1, 5)) AS scope_tags
  FROM gen),
bodies AS (SELECT *, {O.strip_ws(body)} AS body FROM drafts),
counted AS (SELECT *, CAST({O.word_count('body')} AS INTEGER) AS word_count, {marker} AS marker FROM bodies),
checked AS (
  SELECT *,
    list_filter([
      CASE WHEN {O.strip_ws('what_changed')} = '' THEN 'empty ''what changed''' END,
      CASE WHEN {O.strip_ws('why_it_matters')} = '' THEN 'empty ''why it matters''' END,
      CASE WHEN word_count < {MIN_WORDS} THEN 'too short (' || word_count || ' words < {MIN_WORDS})'
           WHEN word_count > {MAX_WORDS} THEN 'too long (' || word_count || ' words > {MAX_WORDS})' END,
      CASE WHEN marker IS NOT NULL THEN 'placeholder/refusal text: ' || {quoted} END,
      CASE WHEN {O.strip_ws('title')} = '' THEN 'empty title' END,
      CASE WHEN len(related) > 0 AND {O.strip_ws('comparison')} = '' THEN 'missing comparison section' END
    ]::VARCHAR[], lambda x: x IS NOT NULL) AS quality_issues,
    ({O.strip_ws('what_changed')} = '' OR word_count < {MIN_WORDS} OR marker IS NOT NULL
       OR {O.strip_ws('title')} = '') AS failed
  FROM counted),
articles AS (
  SELECT *, CASE WHEN failed THEN 'fail' WHEN len(quality_issues) > 0 THEN 'flagged' ELSE 'pass' END AS quality_status
  FROM checked)"""


GEN_SQL = _generation_sql()


@register("work_queue", f"""
WITH {O.doc_items_cte()}, {O.scored_cte(TEST_SCOPE)},
mx AS (SELECT max(run_id) AS m FROM items),
arts AS (SELECT item_id FROM scored, mx WHERE relevant AND run_id < m)
SELECT item_id, strftime(coalesce(published_at, fetched_at), '%Y-%m-%d %H:%M:%S') AS queue_key
FROM scored WHERE relevant AND item_id NOT IN (SELECT item_id FROM arts)
ORDER BY coalesce(published_at, fetched_at) DESC, item_id DESC LIMIT 20""")
def work_queue_q(spark, sf_dir):
    items = materialize(apply_relevance(document_items(spark, sf_dir), TEST_SCOPE).select(
        "item_id", "run_id", "published_at", "fetched_at", "relevant", "status"))
    last = items.agg(F.max("run_id").alias("_m"))
    articles = (items.crossJoin(F.broadcast(last))          # one row
                .where(F.col("relevant") & (F.col("run_id") < F.col("_m"))).select("item_id"))
    q = work_queue(items, articles, limit=20)
    return q.select("item_id", F.date_format(F.coalesce("published_at", "fetched_at"),
                                             "yyyy-MM-dd HH:mm:ss").alias("queue_key"))


@register("scope_tags", f"""WITH {O.doc_items_cte()}, {O.scored_cte(TEST_SCOPE)}
SELECT item_id, array_to_string(list_concat([{O.q(TEST_SCOPE.name)}]::VARCHAR[], list_slice(strong_hits, 1, 5)), '|') AS tags
FROM scored WHERE relevant""")
def scope_tags_q(spark, sf_dir):
    return relevant_items(spark, sf_dir).select("item_id", F.array_join(scope_tags(TEST_SCOPE), "|").alias("tags"))


@register("answer_merge", f"""WITH {GEN_SQL}
SELECT item_id, engine, what_changed, why_it_matters, comparison FROM articles""")
def answer_merge_q(spark, sf_dir):
    return article_store(spark, sf_dir).articles().select("item_id", "engine", "what_changed", "why_it_matters",
                                           "comparison")


@register("quality_gate", f"""WITH {GEN_SQL}
SELECT item_id, quality_status, array_to_string(quality_issues, ' | ') AS issues, word_count
FROM articles""")
def quality_gate_q(spark, sf_dir):
    return article_store(spark, sf_dir).articles().select(
        "item_id", "quality_status", F.array_join("quality_issues", " | ").alias("issues"),
        F.col("word_count").cast("int").alias("word_count"))


@register("articles", f"""WITH {GEN_SQL}
SELECT CAST(row_number() OVER (ORDER BY item_id) AS BIGINT) AS article_id, item_id, title, engine,
       quality_status, array_to_string(scope_tags, '|') AS tags,
       CAST(len(related) AS INTEGER) AS n_comparisons, body
FROM articles""")
def articles_q(spark, sf_dir):
    return article_store(spark, sf_dir).with_children().select(
        "article_id", "item_id", "title", "engine", "quality_status", F.array_join("scope_tags", "|").alias("tags"),
        F.size("comparisons").alias("n_comparisons"), "body")
