"""Queries for run reports, health verdicts and alerts.

A run history is derived from ``events``: one run per 15-minute window; a
source is ``src`` + user_id % 8; fetched = non-error events; a source errored
when it had only error events; relevant = purchases; generated = signups of
value >= 25 (pass >= 50); fallbacks = clicks under 1; the run crashed when an
error event has value >= 450.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.operators.reports import alert, count_map, health
from curata.sources.tables import read_table

RUN_URL = "https://ci.example.org/runs/1"

_RUNS_SQL = """ev AS (
  SELECT time_bucket(INTERVAL '15 minutes', ts) AS run_ts, 'src' || CAST(user_id % 8 AS VARCHAR) AS source_id,
         event_type, value, event_id FROM events),
per_src AS (
  SELECT run_ts, source_id, count(*) FILTER (WHERE event_type <> 'error') AS ok_n,
         count(*) FILTER (WHERE event_type = 'error') AS err_n FROM ev GROUP BY run_ts, source_id),
errs AS (
  SELECT run_ts, list(source_id ORDER BY source_id) AS error_sources FROM per_src
  WHERE ok_n = 0 AND err_n > 0 GROUP BY run_ts),
per AS (
  SELECT run_ts, array_to_string(list(source_id || '=' || CAST(ok_n AS VARCHAR) ORDER BY source_id), ',') AS per_source
  FROM per_src WHERE ok_n > 0 GROUP BY run_ts),
runs AS (
  SELECT run_ts,
    CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS fetched,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS duplicates,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS relevant,
    CAST(count(*) FILTER (WHERE event_type = 'signup' AND value >= 25) AS BIGINT) AS generated,
    CAST(count(*) FILTER (WHERE event_type = 'signup' AND value >= 50) AS BIGINT) AS passed,
    CAST(count(*) FILTER (WHERE event_type = 'signup' AND value >= 25 AND value < 50) AS BIGINT) AS flagged,
    CAST(0 AS BIGINT) AS failed_quality,
    CAST(count(*) FILTER (WHERE event_type = 'click' AND value < 1) AS BIGINT) AS llm_fallbacks,
    min(CASE WHEN event_type = 'error' AND value >= 450 THEN event_id END) AS crash_id
  FROM ev GROUP BY run_ts),
rep AS (
  SELECT r.*, coalesce(e.error_sources, []::VARCHAR[]) AS error_sources, coalesce(p.per_source, '') AS per_source,
         crash_id IS NULL AS ok,
         CASE WHEN crash_id IS NOT NULL THEN 'RuntimeError: crash at event ' || CAST(crash_id AS VARCHAR) END AS error
  FROM runs r LEFT JOIN errs e USING (run_ts) LEFT JOIN per p USING (run_ts)),
hv AS (
  SELECT *,
    CASE WHEN NOT ok THEN 'failure' WHEN fetched = 0 AND len(error_sources) > 0 THEN 'failure'
         WHEN relevant = 0 AND generated = 0 THEN 'empty_news' ELSE 'ok' END AS status,
    CASE WHEN NOT ok THEN 'pipeline failed: ' || coalesce(error, 'None')
         WHEN fetched = 0 AND len(error_sources) > 0 THEN 'all sources failed (' || CAST(len(error_sources) AS VARCHAR) || ' errored, 0 items fetched)'
         WHEN relevant = 0 AND generated = 0 THEN 'no relevant news and no new articles today'
         ELSE 'published/updated ' || CAST(generated AS VARCHAR) || ' article(s) from ' || CAST(relevant AS VARCHAR) || ' relevant item(s)' END AS summary
  FROM rep)"""


def run_history(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    ev = ev.select(F.window("ts", "15 minutes").start.alias("run_ts"),
                   F.concat(F.lit("src"), (F.col("user_id") % 8).cast("string")).alias("source_id"),
                   "event_type", "value", "event_id")
    per_src = ev.groupBy("run_ts", "source_id").agg(
        F.count_if(F.col("event_type") != "error").alias("ok_n"),
        F.count_if(F.col("event_type") == "error").alias("err_n"))
    errs = (per_src.where((F.col("ok_n") == 0) & (F.col("err_n") > 0))
            .groupBy("run_ts").agg(F.array_sort(F.collect_list("source_id")).alias("error_sources")))
    per = (count_map(per_src.where(F.col("ok_n") > 0), ["run_ts"], "source_id", "ok_n")
           .select("run_ts", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(
               e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("per_source")))
    t = F.col("event_type")
    runs = ev.groupBy("run_ts").agg(
        F.count_if(t != "error").alias("fetched"),
        F.count_if(t == "view").alias("duplicates"),
        F.count_if(t == "purchase").alias("relevant"),
        F.count_if((t == "signup") & (F.col("value") >= 25)).alias("generated"),
        F.count_if((t == "signup") & (F.col("value") >= 50)).alias("passed"),
        F.count_if((t == "signup") & (F.col("value") >= 25) & (F.col("value") < 50)).alias("flagged"),
        F.lit(0).cast("bigint").alias("failed_quality"),
        F.count_if((t == "click") & (F.col("value") < 1)).alias("llm_fallbacks"),
        F.min(F.when((t == "error") & (F.col("value") >= 450), F.col("event_id"))).alias("crash_id"))
    rep = (runs.join(errs, "run_ts", "left").join(per, "run_ts", "left")
           .withColumn("error_sources", F.coalesce("error_sources", F.array().cast("array<string>")))
           .withColumn("per_source", F.coalesce("per_source", F.lit("")))
           .withColumn("ok", F.col("crash_id").isNull())
           .withColumn("error", F.when(F.col("crash_id").isNotNull(), F.concat(
               F.lit("RuntimeError: crash at event "), F.col("crash_id").cast("string")))))
    h = health(F.col("ok"), F.col("error"), F.col("fetched"), F.size("error_sources"),
               F.col("relevant"), F.col("generated"))
    return rep.withColumn("h", h).select("*", F.col("h.status").alias("status"),
                                          F.col("h.summary").alias("summary")).drop("h")


def _ts(c="run_ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("run")


@register("source_counts", f"""WITH {_RUNS_SQL}
SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run, source_id, CAST(ok_n AS BIGINT) AS fetched
FROM per_src WHERE ok_n > 0""")
def source_counts_q(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "ts", "user_id", "event_type")
    ev = ev.where(F.col("event_type") != "error").select(
        F.window("ts", "15 minutes").start.alias("run_ts"),
        F.concat(F.lit("src"), (F.col("user_id") % 8).cast("string")).alias("source_id"))
    return ev.groupBy("run_ts", "source_id").agg(F.count(F.lit(1)).alias("fetched")).select(
        _ts(), "source_id", "fetched")


@register("run_report", f"""WITH {_RUNS_SQL}
SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run, fetched, duplicates, relevant, generated, passed,
       flagged, failed_quality, llm_fallbacks, CAST(len(error_sources) AS INTEGER) AS n_source_errors,
       per_source, ok FROM hv""")
def run_report_q(spark, sf_dir):
    return run_history(spark, sf_dir).select(
        _ts(), "fetched", "duplicates", "relevant", "generated", "passed", "flagged", "failed_quality",
        "llm_fallbacks", F.size("error_sources").alias("n_source_errors"), "per_source", "ok")


@register("health_verdict", f"""WITH {_RUNS_SQL}
SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run, status, summary FROM hv""")
def health_verdict_q(spark, sf_dir):
    return run_history(spark, sf_dir).select(_ts(), "status", "summary")


def _alert_sql() -> str:
    srcs = ("CASE WHEN len(error_sources) > 0 THEN '[' || array_to_string(list_transform(error_sources, "
            "lambda k: '''' || k || ''''), ', ') || ']' ELSE 'none' END")
    nl = "chr(10)"
    body = (f"'**' || summary || '**' || {nl} || {nl} || '**Discovery**' || {nl}"
            f" || '- fetched: ' || fetched || {nl} || '- relevant: ' || relevant || {nl}"
            f" || '- duplicates: ' || duplicates || {nl} || '- source errors: ' || {srcs} || {nl} || {nl}"
            f" || '**Generation**' || {nl} || '- generated: ' || generated || ' (pass=' || passed"
            f" || ', flagged=' || flagged || ', fail=' || failed_quality || ')' || {nl}"
            f" || '- llm fallbacks: ' || llm_fallbacks || {nl} || {nl}"
            f" || CASE WHEN error IS NOT NULL THEN '**Error**' || {nl} || '```' || {nl} || error || {nl}"
            f" || '```' || {nl} || {nl} ELSE '' END"
            f" || '[workflow run]({RUN_URL})'")
    return f"""WITH {_RUNS_SQL}
SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run,
       CASE WHEN status = 'failure' THEN '🔴 Curation pipeline failure'
            ELSE '🟡 Curation: empty-news day (nothing published)' END AS title,
       {body} AS body
FROM hv WHERE status IN ('failure', 'empty_news')"""


@register("alert_text", _alert_sql())
def alert_text_q(spark, sf_dir):
    h = run_history(spark, sf_dir).where(F.col("status").isin("failure", "empty_news"))
    a = alert(F.col("status"), F.col("summary"), F.col("fetched"), F.col("relevant"),
              F.col("duplicates"), F.col("error_sources"), F.col("generated"), F.col("passed"),
              F.col("flagged"), F.col("failed_quality"), F.col("llm_fallbacks"), F.col("error"),
              RUN_URL)
    return h.select(_ts(), a["title"].alias("title"), a["body"].alias("body"))
