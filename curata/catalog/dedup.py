"""Queries for deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.functions.urls import with_identity
from curata.oracle import sql as O
from curata.operators.dedup import (dedupe_within_batch, flag_earlier_runs, insert_or_ignore,
                                    winners_by_key)
from curata.sources.items import document_items, mixed_batch, page_items


def _keys(src: str) -> str:
    nt = O.normalize_title("title")
    return f"""keyed AS (
  SELECT *, sha1({O.normalize_url('url')}) AS url_fp,
         CASE WHEN {nt} <> '' THEN sha1({nt}) END AS title_key
  FROM {src})"""


@register("dedup_by_url", f"""
WITH {O.page_items_cte()}, {_keys('page_items')}
SELECT item_id, url_fp,
       row_number() OVER (PARTITION BY url_fp ORDER BY source_weight DESC, seq) = 1 AS is_winner
FROM keyed""")
def dedup_by_url(spark, sf_dir):
    items = with_identity(page_items(spark, sf_dir))
    return winners_by_key(items, "url_fp").select("item_id", "url_fp", "is_winner")


@register("dedup_by_title", f"""
WITH {O.doc_items_cte()}, {O.mixed_batch_cte()}, {_keys('mixed')}
SELECT seq, title_key,
       CASE WHEN title_key IS NULL THEN true ELSE
         row_number() OVER (PARTITION BY title_key ORDER BY source_weight DESC, seq) = 1 END AS is_winner
FROM keyed""")
def dedup_by_title(spark, sf_dir):
    items = with_identity(mixed_batch(document_items(spark, sf_dir)))
    return winners_by_key(items, "title_key").select("seq", "title_key", "is_winner")


@register("dedup_cross_run", f"""
WITH {O.doc_items_cte()}, {_keys('items')},
fu AS (SELECT url_fp, min(run_id) AS fu FROM keyed GROUP BY url_fp),
ft AS (SELECT title_key, min(run_id) AS ft FROM keyed WHERE title_key IS NOT NULL GROUP BY title_key)
SELECT k.item_id, k.run_id, coalesce(fu.fu < k.run_id, false) OR coalesce(ft.ft < k.run_id, false) AS cross_dup
FROM keyed k LEFT JOIN fu USING (url_fp) LEFT JOIN ft USING (title_key)""")
def dedup_cross_run(spark, sf_dir):
    items = with_identity(document_items(spark, sf_dir))
    return flag_earlier_runs(items).select("item_id", "run_id", "cross_dup")


@register("insert_or_ignore", f"""
WITH {O.page_items_cte()}, {_keys('page_items')}
SELECT item_id, url_fp,
       row_number() OVER (PARTITION BY url_fp ORDER BY run_id, seq) = 1 AS inserted
FROM keyed""")
def insert_or_ignore_q(spark, sf_dir):
    items = with_identity(page_items(spark, sf_dir))
    ins = insert_or_ignore(items, None, order=["run_id", "seq"]).select(
        "item_id", F.lit(True).alias("_ins"))
    return (items.join(ins, "item_id", "left")
            .select("item_id", "url_fp", F.coalesce("_ins", F.lit(False)).alias("inserted")))


def leader_ctes() -> str:
    """``told`` (seq, slot, dup_at) from ``keyed`` (seq, source_weight, url_fp, title_key). The
    rule stated row by row in order of ``seq``: a row meets the slot that its URL key,
    else its title key, is registered for. Without one it opens a slot; a strictly heavier
    row takes the slot over, and the one it displaces becomes a duplicate; any other row is a
    duplicate. Only rows that hold a slot register their keys."""
    kept = ("map_concat(acc.keys, CASE WHEN x.t IS NULL THEN MAP {x.u: acc.slot}"
            " ELSE MAP {x.u: acc.slot, x.t: acc.slot} END)")
    holder = "map_concat(acc.held, MAP {acc.slot: {'seq': x.seq, 'w': x.w}})"
    blank = "NULL::BIGINT"
    start = ("{'keys': MAP {}::MAP(VARCHAR, BIGINT), 'held': MAP {}::MAP(BIGINT, STRUCT(seq BIGINT, w DOUBLE)),"
             " 'slot': 0::BIGINT, 'events': []::STRUCT(seq BIGINT, slot BIGINT, dup_at BIGINT)[]}")

    def state(slot, keys="acc.keys", held="acc.held", events="acc.events"):
        return f"{{'keys': {keys}, 'held': {held}, 'slot': {slot}, 'events': {events}}}"

    found = "coalesce(acc.keys[x.u], acc.keys[x.t], x.seq)"
    looked = f"list_transform([acc], lambda acc: {state(found)})[1]"
    opened = state("acc.slot", kept, holder,
                   f"list_append(acc.events, {{'seq': x.seq, 'slot': acc.slot, 'dup_at': {blank}}})")
    taken = state("acc.slot", kept, holder,
                  "list_concat(acc.events, [{'seq': acc.held[acc.slot].seq, 'slot': acc.slot, 'dup_at': x.seq},"
                  f" {{'seq': x.seq, 'slot': acc.slot, 'dup_at': {blank}}}])")
    lost = state("acc.slot", events="list_append(acc.events, {'seq': x.seq, 'slot': acc.slot, 'dup_at': x.seq})")
    step = (f"list_transform([{looked}], lambda acc: CASE WHEN acc.slot = x.seq THEN {opened}"
            f" WHEN x.w > acc.held[acc.slot].w THEN {taken} ELSE {lost} END)[1]")
    return f"""
listed AS (SELECT list({{'seq': seq, 'w': coalesce(source_weight, 0), 'u': 'u' || url_fp, 't': 't' || title_key}}
                       ORDER BY seq) AS xs FROM keyed),
folded AS (SELECT unnest(list_reduce(xs, lambda acc, x: {step}, {start}).events) AS e FROM listed),
told AS (SELECT e.seq AS seq, max(e.slot) AS slot, max(e.dup_at) AS dup_at FROM folded GROUP BY 1)"""


@register("dedup_leader", f"""
WITH {O.doc_items_cte()}, {O.mixed_batch_cte()}, {_keys('mixed')}, {leader_ctes()}
SELECT k.seq, k.item_id, dup_at IS NOT NULL AS batch_dup, slot, dup_at
FROM keyed k JOIN told USING (seq)""")
def dedup_leader(spark, sf_dir):
    batch = with_identity(mixed_batch(document_items(spark, sf_dir)))
    return dedupe_within_batch(batch).select("seq", "item_id", "batch_dup", "slot", "dup_at")
