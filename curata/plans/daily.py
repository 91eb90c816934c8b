"""The daily run (C11, S15): discovery, generation, publication, and its status row.

Everything of a run lies below one root: ``items`` and ``runs`` (discovery), ``articles``
(the article store), ``site`` (feeds, search index) and ``status``. Each stage reads what the
one before it committed, so a run that was cut off goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators.reports import health
from curata.plans.discovery import archived_items, discovery_run
from curata.plans.generation import generate, work_queue
from curata.plans.publication import publish
from curata.scope import Scope
from curata.session import materialize
from curata.sources.archive import uncached, with_cached_content
from curata.sources.store import ArticleStore
from curata.sources.tables import path_exists

STATUS = ("run_id bigint, ok boolean, error string, discovery map<string,bigint>, generation map<string,bigint>, "
          "site map<string,bigint>")


def generation_run(store: ArticleStore, items: DataFrame, landed: DataFrame, scope: Scope, run_id: int, created_at: str,
                   limit: int = 50, answers: DataFrame | None = None, **options) -> dict[str, int]:
    """Articles for the newest relevant items without one. ``landed``: texts of pages by URL
    key (url_fp, content, content_fetched_at); items without one are written from their summary."""
    relevant = items.where(F.col("status") == "relevant")
    queue = materialize(work_queue(relevant, store.articles(), limit).drop("content", "content_fetched_at"))
    considered = queue.count()
    missing = uncached(queue, landed).count()
    drafts = generate(with_cached_content(queue, landed), relevant, scope, answers, **options)
    return store.append(drafts, run_id, created_at, {"considered": considered, "content_fetched": considered - missing})


def run_daily(batch: DataFrame, landed: DataFrame, root: str, scope: Scope, run_id: int, now: str, limit: int = 50,
              answers: DataFrame | None = None, base_url: str = "", title: str = "Curated", description: str = "",
              **options) -> dict:
    """One day over the items of ``batch``. A failure is captured in the report, which is
    written either way."""
    spark = batch.sparkSession
    report: dict = {"ok": True, "error": None, "discovery": {}, "generation": {}, "site": {}}
    try:
        report["discovery"] = discovery_run(batch, root, scope, run_id)
        store, items = ArticleStore(spark, f"{root}/articles"), archived_items(spark, root)
        report["generation"] = generation_run(store, items, landed, scope, run_id, now, limit, answers, **options)
        report["site"] = publish(store, items, f"{root}/site", title, description, now, base_url)
    except Exception as failure:  # the report tells; the caller decides what follows
        report.update(ok=False, error=f"{type(failure).__name__}: {failure}")
    row = (run_id, *(report[c] for c in ("ok", "error", "discovery", "generation", "site")))
    spark.createDataFrame([row], STATUS).coalesce(1).write.mode("append").parquet(f"{root}/status")
    return report


def run_status(spark: SparkSession, root: str) -> DataFrame:
    """Every run's report with its health verdict, and both as one JSON text."""
    if not path_exists(spark, f"{root}/status"):
        return spark.createDataFrame([], STATUS + ", health struct<status:string,summary:string>, value string")
    count = lambda of, name: F.coalesce(F.col(of)[name], F.lit(0))
    verdict = health(F.col("ok"), F.col("error"), count("discovery", "fetched"), count("discovery", "source_errors"),
                     count("discovery", "relevant"), count("generation", "generated"))
    rows = spark.read.schema(STATUS).parquet(f"{root}/status").withColumn("health", verdict)
    report = F.struct("ok", "error", "discovery", "generation", "site")
    return rows.withColumn("value", F.to_json(F.struct("health", report.alias("report")), {"ignoreNullFields": "false"}))
