"""Article generation pass (C9): queue -> content -> related priors -> summary
(model answer with extractive fallback) -> tags, sources, links -> quality gate.

One job for the whole queue: related priors for all candidates come from one
similarity join (N4: the relevant set is the corpus), drafts are projections,
children are nested arrays. Failed and flagged drafts are kept for audit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions.keywords import keyword_hits
from curata.functions.text import scoring_text
from curata.operators.quality import check
from curata.operators.relevance import scope_tags
from curata.operators.similarity import find_related
from curata.operators.summarize import assemble_body, extracted, extractive, merge_answers
from curata.scope import Scope
from curata.session import ship_package, stored

PART_ITEMS = 1000               # items of a part, about, whose related texts are held together
_HELD_CHARS = 8 << 20           # characters of related texts in a batch that leaves a task


def work_queue(items: DataFrame, articles: DataFrame | None, limit: int | None = 20) -> DataFrame:
    """Relevant items without an article, newest first (published, else first
    seen; then id), at most ``limit`` (the queue size is the feature)."""
    q = items.where(F.col("status") == "relevant")
    if articles is not None:
        q = q.join(articles.select("item_id"), "item_id", "left_anti")
    q = q.orderBy(F.coalesce("published_at", "fetched_at").desc(), F.desc("item_id"))
    return q.limit(limit) if limit is not None else q


def related_arrays(related: DataFrame) -> DataFrame:
    """(item_id, related array<struct> in rank order); at most k rows per item. The summaries
    are there where ``related`` has them."""
    texts = [c for c in ("related_title", "related_url", "related_summary") if c in related.columns]
    return related.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "rank", "related_item_id", *texts, "similarity"))),
        lambda r: r.dropFields("rank")).alias("related"))


def with_related(items: DataFrame, related: DataFrame) -> DataFrame:
    """``items`` with the array ``related``, empty for an item without related priors."""
    listed = related_arrays(related)
    return items.join(listed, "item_id", "left").withColumn(
        "related", F.coalesce("related", F.array().cast(listed.schema["related"].dataType)))


def with_related_texts(items: DataFrame, pairs: DataFrame, priors: DataFrame) -> DataFrame:
    """``with_related`` with the whole related summaries, for ``pairs`` (item_id,
    related_item_id, similarity, rank). A long text is many items' related one: items are dealt by
    their first related prior, some ``PART_ITEMS`` to a part, and each text a part needs is sent
    there once; the rows are put together in the part."""
    ship_package(items.sparkSession)
    parts = max(1, -(-items.count() // PART_ITEMS))
    listed = pairs.groupBy("item_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "related_item_id", "similarity"))).alias("_asked"))
    # the items of one prior are many: every PART_ITEMS of them go to another part
    crowd = pairs.where("rank = 1").groupBy("related_item_id").agg(
        F.ceil(F.count(F.lit(1)) / PART_ITEMS).alias("_shares"))
    dealt = listed.withColumn("related_item_id", F.col("_asked")[0]["related_item_id"]).join(
        crowd, "related_item_id", "left").select("item_id", "_asked", F.pmod(F.xxhash64("related_item_id", F.pmod(
            F.xxhash64("item_id"), F.coalesce("_shares", F.lit(1)))), F.lit(parts)).cast("int").alias("_part"))
    dealt = stored(dealt, "related-dealt")
    texts = dealt.select("_part", F.explode("_asked.related_item_id").alias("related_item_id")).distinct().join(
        priors.select(F.col("item_id").alias("related_item_id"), F.col("title").alias("related_title"),
                      F.col("url").alias("related_url"), F.col("summary").alias("related_summary")), "related_item_id")
    info = ["related_title", "related_url", "related_summary"]
    kind = ("array<struct<related_item_id:bigint," + "".join(f"{c}:string," for c in info) + "similarity:double>>")
    own = items.join(dealt, "item_id", "left").withColumn("_part", F.coalesce("_part", F.pmod(
        F.xxhash64("item_id"), F.lit(parts)).cast("int"))).select(
        F.col("_part").alias("part"), F.lit(1).alias("kind"), F.col("_asked").alias("asked"), F.struct(*items.columns).alias("item"),
        F.lit(None).cast("bigint").alias("prior"), *(F.lit(None).cast("string").alias(c) for c in info))
    sent = texts.select(F.col("_part").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(own.schema["asked"].dataType).alias("asked"),
                        F.lit(None).cast(own.schema["item"].dataType).alias("item"), F.col("related_item_id").alias("prior"), *info)
    rows = sent.unionByName(own).repartitionById(parts, "part").sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple]] = {}
        for batch in batches:
            split = int(pc.sum(pc.equal(batch["kind"], 0)).as_py() or 0)
            texts = batch.slice(0, split)
            for key, *text in zip(texts["prior"].to_pylist(), *(texts[c].to_pylist() for c in info)):
                known.setdefault(key, []).append(tuple(text))
            rest = batch.slice(split)
            listed = []
            for asked in rest["asked"].to_pylist():
                # as array_sort has it: nulls first
                found = [((a["rank"], a["related_item_id"], *((t is not None, t or "") for t in text)), a, text)
                         for a in asked or [] for text in known.get(a["related_item_id"], [])]
                listed.append([{"related_item_id": a["related_item_id"], **dict(zip(info, text)), "similarity": a["similarity"]}
                               for _, a, text in sorted(found, key=lambda x: x[0])])
            sizes = [sum(len(t or "") for r in rows for t in r.values() if isinstance(t, str)) for rows in listed]
            at = rest.schema.get_field_index("item")
            start, held = 0, 0
            for i, size in enumerate([*sizes, 0]):
                if i > start and (i == len(sizes) or held + size > _HELD_CHARS):
                    yield pa.RecordBatch.from_arrays([rest.column(at).slice(start, i - start),
                                                      pa.array(listed[start:i], kinds)], names=["item", "related"])
                    start, held = i, 0
                held += size

    kinds = pa.list_(pa.struct([("related_item_id", pa.int64()), *((c, pa.string()) for c in info), ("similarity", pa.float64())]))
    schema = T.StructType([T.StructField("item", own.schema["item"].dataType), T.StructField("related", T.DataType.fromDDL(kind))])
    return rows.select("kind", "asked", "item", "prior", *info).mapInArrow(run, schema).select("item.*", "related")


def own_parts(queue: DataFrame, scope: Scope) -> DataFrame:
    """What a draft takes from its item alone: the salient sentences and the tags, without the texts."""
    tags = scope_tags(scope, hits=None if "strong_hits" in queue.columns else keyword_hits(
        scoring_text("title", "summary"), scope.strong))
    return extracted(queue).withColumn("scope_tags", tags).select(
        "item_id", "title", "url", "source_id", "what_changed", "scope_tags")


def generate(queue: DataFrame, relevant: DataFrame, scope: Scope, answers: DataFrame | None = None,
             top_k: int = 3, min_similarity: float = 0.08, min_words: int = 40,
             max_words: int = 320, model: str = "", related: DataFrame | None = None,
             own: DataFrame | None = None) -> DataFrame:
    """Drafts with quality verdicts for every queued item. ``related``, ``own``: the related priors
    and the queue's ``own_parts``, where they have been made and written before."""
    if related is None:
        related = find_related(queue, relevant, top_k, min_similarity).drop("related_summary")
    # what a draft takes from the item's texts is taken before any join, so no text is shuffled
    inputs = with_related(own_parts(queue, scope) if own is None else own, related)
    drafts = (merge_answers(inputs, answers, scope.name, model) if answers is not None
              else extractive(inputs, scope.name).withColumn("fallback", F.lit(False)))
    drafts = drafts.withColumns({
        "sources": F.array(F.struct(F.col("url").alias("url"), F.col("title").alias("title"),
                                    F.col("source_id").alias("source_id"),
                                    F.lit(True).alias("is_primary"))),
        "comparisons": F.transform("related", lambda r: F.struct(
            r["related_item_id"].alias("related_item_id"), r["related_title"].alias("related_title"),
            r["related_url"].alias("related_url"), r["similarity"].alias("similarity"),
            F.lit("").alias("note"))),
        "body": assemble_body(),
    })
    return check(drafts, min_words, max_words, require_comparison=F.size("related") > 0)
