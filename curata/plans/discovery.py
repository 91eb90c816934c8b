"""Discovery run (C10): scan -> in-batch dedup -> archive dedup -> score ->
insert-or-ignore into the archive, with the run report (A1, A2).

All frames stay lazy until the archive write; the archive snapshot is the set of
runs strictly before the current one, so a rerun of a day is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from curata.functions.urls import with_identity
from curata.operators.dedup import GROUP_UNIQUE, dedupe, insert_or_ignore
from curata.operators.relevance import apply_relevance
from curata.scope import Scope, TEST_SCOPE
from curata.session import stored
from curata.sources.archive import ITEM_SCHEMA, dense_ids, read_items, write_items
from curata.sources.items import document_items
from curata.sources.tables import path_exists


def top_relevant(spark: SparkSession, sf_dir: str, k: int = 20,
                 scope: Scope = TEST_SCOPE) -> DataFrame:
    """The k highest-scoring items (a top-k report: TakeOrderedAndProject)."""
    scored = apply_relevance(document_items(spark, sf_dir), scope)
    return (scored.orderBy(F.desc("relevance_score"), F.asc("item_id")).limit(k)
            .select("item_id", "source_id", "title", "relevance_score", "relevant",
                    F.array_join("relevance_reasons", " | ").alias("reasons")))


def discover(batch: DataFrame, archive: DataFrame, scope: Scope, run_id: int) -> DataFrame:
    """One discovery run over ``batch`` (items of the run) against ``archive``
    (items of earlier runs, with identity columns). Returns the batch rows with
    identity, dedup verdict, relevance verdict and final ``status``."""
    b = with_identity(batch).withColumn("run_id", F.lit(run_id).cast("bigint"))
    d = dedupe(b, archive)
    scored = apply_relevance(d, scope)
    duplicate = F.col("status_dedup") == "duplicate"
    # only unique rows are scored: duplicates keep no score and no reasons
    return scored.withColumns({
        "status": F.when(duplicate, F.lit("duplicate")).otherwise(F.col("status")),
        "relevance_score": F.when(duplicate, F.lit(0.0)).otherwise(F.col("relevance_score")),
        "relevance_reasons": F.when(duplicate, F.array().cast("array<string>")).otherwise(F.col("relevance_reasons")),
        "is_unique": F.col("insert_group") == GROUP_UNIQUE})


def run_counters() -> list:
    """A2, over the rows of a run: taken while they are written."""
    return [F.count(F.lit(1)).alias("fetched"),
            F.count_if(F.col("status") == "duplicate").alias("duplicates"),
            F.count_if(F.col("status") != "duplicate").alias("unique"),
            F.count_if(F.col("status") == "relevant").alias("relevant"),
            F.count_if(F.col("status") == "irrelevant").alias("irrelevant")]


LEDGER = "run_id bigint, stats map<string,bigint>, per_source map<string,bigint>"


def run_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished discovery run."""
    path = f"{root}/runs"
    return (spark.read.schema(LEDGER).parquet(path) if path_exists(spark, path)
            else spark.createDataFrame([], LEDGER))


def archived_items(spark: SparkSession, root: str, before_run: int | None = None) -> DataFrame:
    path = f"{root}/items"
    if path_exists(spark, path):
        return read_items(spark, path, before_run)
    return spark.createDataFrame([], ITEM_SCHEMA)


def discovery_run(batch: DataFrame, root: str, scope: Scope, run_id: int) -> dict[str, int]:
    """One discovery run over ``batch`` into the archive below ``root``: dedup against the
    batch and the earlier runs, verdicts, insert-or-ignore, ids, and last the ledger row with
    the counters. A finished run is not run again; one that was cut off is, and overwrites only
    its own partition."""
    spark = batch.sparkSession
    done = run_ledger(spark, root).where(F.col("run_id") == run_id).select("stats").collect()
    if done:
        return done[0].stats
    archive = archived_items(spark, root, before_run=run_id)
    rows = discover(batch, archive, scope, run_id)
    result = Observation()
    kept = [c for c in rows.columns if c not in ("content", "strong_hits", "normal_hits", "signal_hits", "exclude_hits")]
    # the rows are written once, and counted in that pass; everything after reads them back
    seen = stored(rows.select(*kept).observe(result, *run_counters()), "run-rows")
    order = ["insert_group", "insert_at", "seq"]
    # which rows stay, and their ids, are told from keys; the texts are joined once
    inserted = insert_or_ignore(seen.select("url_fp", *order), archive.select("url_fp"), order=order)
    last = archive.agg(F.max("item_id")).first()[0] or 0
    numbered = seen.drop("item_id").join(dense_ids(inserted, order, start=last + 1, id_col="item_id"), order)
    if "fetched_at" not in numbered.columns:
        numbered = numbered.withColumn("fetched_at", F.current_timestamp())
    if "first_seen_at" not in numbered.columns:
        numbered = numbered.withColumn("first_seen_at", F.col("fetched_at"))
    written = Observation()
    write_items(numbered.observe(written, F.count(F.lit(1)).alias("inserted")), f"{root}/items")
    stats = {k: int(v) for k, v in (result.get | written.get).items()}
    sources = {r.source_id: r.n for r in seen.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark.createDataFrame([(run_id, stats, sources)], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return stats
