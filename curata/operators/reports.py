"""Run reports, counts and health verdicts.

Reports are one-row-per-run DataFrames built with a single aggregation pass
(``count_if``), so a whole history of runs is scored by the same plan as one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_STATUSES = ("new", "relevant", "irrelevant", "duplicate")
QUALITY_STATUSES = ("pass", "flagged", "fail")

HEALTH_OK, HEALTH_EMPTY, HEALTH_FAILURE = "ok", "empty_news", "failure"


def _domain(spark, name: str, values) -> DataFrame:
    # the fixed value domain of the operator (not data): a handful of rows
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def status_counts(items: DataFrame, status_col: str = "status",
                  domain=ITEM_STATUSES) -> DataFrame:
    """(status, n) for every status of the domain (0 when absent) plus 'total'.
    The domain is a constant of the operator and is broadcast."""
    spark = items.sparkSession
    counts = items.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    dom = _domain(spark, "status", domain)
    per = (F.broadcast(dom).join(counts, "status", "left")
           .select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    total = items.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        F.lit("total").alias("status"), "n")
    return per.unionByName(total)


def per_source_counts(items: DataFrame, source_col: str = "source_id",
                      run_col: str | None = None) -> DataFrame:
    """A1: items per source (per run when ``run_col`` is given)."""
    keys = [run_col, source_col] if run_col else [source_col]
    return items.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("fetched"))


def count_map(df: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """map<key, value> per group, keys sorted."""
    return df.groupBy(*group).agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col(key), F.col(value))))).alias("m"))


def health(ok: Column, error: Column, fetched: Column, n_source_errors: Column,
           relevant: Column, generated: Column) -> Column:
    """struct<status, summary> of one run report row."""
    status = (F.when(~ok, F.lit(HEALTH_FAILURE))
              .when((fetched == 0) & (n_source_errors > 0), F.lit(HEALTH_FAILURE))
              .when((relevant == 0) & (generated == 0), F.lit(HEALTH_EMPTY))
              .otherwise(F.lit(HEALTH_OK)))
    summary = (F.when(~ok, F.concat(F.lit("pipeline failed: "), F.coalesce(error, F.lit("None"))))
               .when((fetched == 0) & (n_source_errors > 0),
                     F.format_string("all sources failed (%d errored, 0 items fetched)", n_source_errors))
               .when((relevant == 0) & (generated == 0),
                     F.lit("no relevant news and no new articles today"))
               .otherwise(F.format_string(
                   "published/updated %d article(s) from %d relevant item(s)", generated, relevant)))
    return F.struct(status.alias("status"), summary.alias("summary"))


def _py_list(keys: Column) -> Column:
    # Python list text of the keys, e.g. ['a', 'b']
    return F.concat(F.lit("["), F.array_join(F.transform(keys, lambda k: F.concat(
        F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))


def alert(status: Column, summary: Column, fetched, relevant, duplicates, error_sources: Column,
          generated, passed, flagged, failed, fallbacks, error: Column, run_url: str = "",
          name: str = "Curation") -> Column:
    """struct<title, body> of the alert for a run verdict."""
    title = F.when(status == HEALTH_FAILURE, F.lit(f"🔴 {name} pipeline failure")).otherwise(
        F.lit(f"🟡 {name}: empty-news day (nothing published)"))
    srcs = F.when(F.size(error_sources) > 0, _py_list(error_sources)).otherwise(F.lit("none"))
    lines = F.concat(
        F.lit("**"), summary, F.lit("**\n\n"),
        F.lit("**Discovery**\n"),
        F.format_string("- fetched: %d\n- relevant: %d\n- duplicates: %d\n", fetched, relevant, duplicates),
        F.lit("- source errors: "), srcs, F.lit("\n\n"),
        F.lit("**Generation**\n"),
        F.format_string("- generated: %d (pass=%d, flagged=%d, fail=%d)\n- llm fallbacks: %d\n\n",
                        generated, passed, flagged, failed, fallbacks),
        F.when(error.isNotNull(), F.concat(F.lit("**Error**\n```\n"), error, F.lit("\n```\n\n")))
        .otherwise(F.lit("")),
        F.lit(f"[workflow run]({run_url})\n" if run_url else ""))
    body = F.regexp_replace(lines, r"\n$", "")
    return F.struct(title.alias("title"), body.alias("body"))
