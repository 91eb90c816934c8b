"""Queries over landed feeds and discovery runs.

The feed files are made from ``pages``: a file per host and day (25 pages), RSS on even days
and Atom on odd ones; every fifth file is cut off and every seventh has no entry.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.catalog import register
from curata.catalog.dedup import _keys, leader_ctes
from curata.catalog.shared import once
from curata.functions.text import xml_escape
from curata.oracle import sql as O
from curata.plans.discovery import discovery_run, run_ledger
from curata.scope import TEST_SCOPE
from curata.session import ship_package
from curata.sources.feeds import scan_feeds, parse_feeds, source_errors
from curata.sources.items import document_items, mixed_batch
from curata.sources.registry import landed, write_file
from curata.sources.tables import read_table

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)"


def _feed_files(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 600)
    text = lambda name, value: F.concat(F.lit(f"<{name}>"), xml_escape(value), F.lit(f"</{name}>"))
    guid = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    rss = F.concat(
        F.lit("<item>"), text("title", title), text("link", F.col("url")),
        text("pubDate", F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss Z")),
        F.lit('<guid isPermaLink="false">'), guid, F.lit("</guid><category>page</category><category></category>"),
        F.lit("<content:encoded>"), xml_escape(F.concat(F.lit("<p>"), title, F.lit("</p>"))), F.lit("</content:encoded></item>"))
    atom = F.concat(
        F.lit("<entry>"), text("title", title), F.lit('<link rel="edit" href="https://edit"/><link href="'),
        xml_escape(F.col("url")), F.lit('"/>'), text("id", guid),
        text("updated", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit('<category term="page"/></entry>'))
    rows = pages.select(F.regexp_extract("url", _HOST, 1).alias("host"), F.floor(F.col("page_id") / 25).alias("day"),
                        "page_id", F.when(F.floor(F.col("page_id") / 25) % 2 == 0, rss).otherwise(atom).alias("entry"))
    files = rows.groupBy("host", "day").agg(  # at most 25 entries
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "entry"))), lambda x: x["entry"]), "").alias("body"))
    body = F.when(F.col("day") % 7 == 6, F.lit("")).otherwise(F.col("body"))
    head = F.concat(F.lit("<title>"), F.col("host"), F.lit(" &amp; co</title>"))
    whole = F.when(F.col("day") % 2 == 0, F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'),
        head, body, F.lit("</channel></rss>"))).otherwise(F.concat(
            F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), head, body, F.lit("</feed>")))
    cut = F.when(F.col("day") % 5 == 4, F.substring(whole, F.lit(1), F.length(whole) - 9)).otherwise(whole)
    return files.select(F.concat("host", F.lit("/"), F.lpad(F.col("day").cast("string"), 9, "0"), F.lit(".xml")).alias("name"),
                        cut.alias("value"))


def landed_feeds(spark, sf_dir) -> str:
    """The folder with the feed files, landed once."""
    def make(path):
        ship_package(spark)

        def write(batches):
            for batch in batches:
                for name, value in zip(batch["name"], batch["value"]):
                    write_file(f"{path}/{name}", value)
                yield batch[["name"]]
        # dealt by number: by bytes, one task would write tens of thousands of small files
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _feed_files(spark, sf_dir).repartition(tasks, "name").mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
        return path
    return once(spark, sf_dir, "landed-feeds", make)


def _sources(spark, sf_dir):
    hosts = read_table(spark, sf_dir, "pages", "url").select(F.regexp_extract("url", _HOST, 1).alias("id")).distinct()
    return hosts.select("id", F.lit("landed_feed").alias("type"), (F.length("id") % 2 == 0).alias("enabled"),
                        (F.length("id") % 3 + 1).cast("double").alias("weight"), (-F.length("id")).alias("position"))


_ENTRIES = f"""feed_rows AS (
  SELECT regexp_extract(url, '{_HOST}', 1) AS source_id, CAST(floor(page_id / 25) AS BIGINT) AS day, page_id, url,
         regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS raw FROM pages),
feed_files AS (SELECT source_id, day, day % 5 = 4 AS cut, day % 7 = 6 AS hollow FROM feed_rows GROUP BY ALL)"""


@register("feed_items", f"""WITH {_ENTRIES},
placed AS (SELECT *, row_number() OVER (PARTITION BY source_id, day ORDER BY page_id) - 1 AS row FROM feed_rows
           WHERE length(source_id) % 2 = 0 AND day % 5 <> 4 AND day % 7 <> 6)
SELECT CAST(-length(source_id) AS INTEGER) AS source_position, source_id, lpad(CAST(day AS VARCHAR), 9, '0') AS file,
       CAST(row AS INTEGER) AS row, url, {O.strip_html('raw')} AS title,
       CASE WHEN day % 2 = 0 THEN {O.strip_html("'<p>' || raw || '</p>'")} ELSE '' END AS summary,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 600), '%Y-%m-%d %H:%M:%S') AS published,
       CAST(length(source_id) % 3 + 1 AS DOUBLE) AS source_weight, source_id || ' & co' AS feed_title, 'page' AS tags,
       'page-' || CAST(page_id AS VARCHAR) AS guid
FROM placed WHERE {O.strip_html('raw')} <> ''""")
def feed_items_q(spark, sf_dir):
    """Items of all enabled sources, read by the registered ``landed_feed`` type."""
    items, _ = scan_feeds(spark, landed_feeds(spark, sf_dir), _sources(spark, sf_dir), "landed_feed")
    return items.select(
        "source_position", "source_id", F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("file"), "row", "url", "title",
        "summary", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "source_weight",
        F.col("metadata.feed_title").alias("feed_title"), F.array_join("metadata.tags", "|").alias("tags"),
        F.col("metadata.guid").alias("guid"))


@register("feed_errors", f"""WITH {_ENTRIES},
told AS (SELECT source_id, day, CASE WHEN cut THEN 'ParseError: not well-formed XML'
                                     WHEN hollow THEN 'EmptyFeed: no entries' END AS error FROM feed_files),
bad AS (SELECT source_id, count(*) FILTER (error IS NULL) AS good, count(error) AS n,
               arg_min(error, day) FILTER (error IS NOT NULL) AS error FROM told GROUP BY source_id)
SELECT source_id, lpad(CAST(day AS VARCHAR), 9, '0') AS file, error FROM told WHERE error IS NOT NULL
UNION ALL SELECT source_id, 'all', error || ' (' || CAST(n AS VARCHAR) || ' files)' FROM bad
WHERE good = 0 AND n > 0 AND length(source_id) % 2 = 0""")
def feed_errors_q(spark, sf_dir):
    """Every file that gave no entry, and the enabled sources none of whose files gave one."""
    parsed = parse_feeds(landed(spark, "files", landed_feeds(spark, sf_dir)))
    files = parsed.where(F.col("error").isNotNull()).select(
        "source_id", F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("file"), "error")
    return files.unionByName(source_errors(parsed, _sources(spark, sf_dir)).withColumn("file", F.lit("all")))


# ------------------------------------------------------------------ discovery runs
def _discovered_sql(src: str, name: str, archive: str | None) -> str:
    """DuckDB: ``<name>`` = the rows of a run over ``src`` with their place in the insert order,
    and ``<name>_stored`` = those that insert-or-ignore keeps."""
    known = (f"(url_fp IN (SELECT url_fp FROM {archive}) OR coalesce(title_key IN (SELECT title_key FROM {archive}"
             f" WHERE title_key IS NOT NULL), false))" if archive else "false")
    fresh = f"AND url_fp NOT IN (SELECT url_fp FROM {archive})" if archive else ""
    told = leader_ctes().replace("keyed", f"{name}_keyed").replace("listed", f"{name}_listed").replace(
        "folded", f"{name}_folded").replace("told AS", f"{name}_told AS")
    return f"""{_keys(src).replace('keyed AS', f'{name}_keyed AS')}, {told},
{name} AS (SELECT k.*, t.dup_at IS NOT NULL AS batch_dup, t.dup_at IS NULL AND {known} AS cross_dup,
                  coalesce(t.dup_at, t.slot) AS place
           FROM {name}_keyed k JOIN {name}_told t USING (seq)),
{name}_stored AS (SELECT * FROM {name} WHERE true {fresh}
  QUALIFY row_number() OVER (PARTITION BY url_fp ORDER BY
    CASE WHEN batch_dup THEN 1 WHEN cross_dup THEN 2 ELSE 0 END, place, seq) = 1)"""


def _counts_sql(run: int, name: str) -> str:
    return f"""SELECT CAST({run} AS BIGINT) AS run_id, count(*) AS fetched,
  count(*) FILTER (batch_dup OR cross_dup) AS duplicates, count(*) FILTER (NOT (batch_dup OR cross_dup)) AS "unique",
  count(*) FILTER (NOT (batch_dup OR cross_dup) AND relevant) AS relevant,
  count(*) FILTER (NOT (batch_dup OR cross_dup) AND NOT relevant) AS irrelevant,
  (SELECT count(*) FROM {name}_stored) AS inserted FROM {name}"""


DISCOVERY_SQL = f"""{O.doc_items_cte()}, {O.mixed_batch_cte()}, {O.scored_cte(TEST_SCOPE, 'mixed')},
early AS (SELECT * FROM scored WHERE run_id % 2 = 0),
{_discovered_sql('early', 'first_run', None)}, {_discovered_sql('scored', 'second_run', 'first_run_stored')}"""


@register("discovery_report", f"""WITH {DISCOVERY_SQL}
{_counts_sql(1, 'first_run')} UNION ALL {_counts_sql(2, 'second_run')}""")
def discovery_report_q(spark, sf_dir):
    """Two runs into an archive of their own: the items of even days, then all items (those of
    the first run are duplicates now). The counters are observed while the archive is written."""
    def make(path):
        batch = mixed_batch(document_items(spark, sf_dir))
        for run, rows in ((1, batch.where(F.col("run_id") % 2 == 0)), (2, batch)):
            discovery_run(rows, path, TEST_SCOPE, run)
        return path
    stats = F.col("stats")
    return run_ledger(spark, once(spark, sf_dir, "discovery-runs", make)).select("run_id", *(
        stats[c].alias(c) for c in ("fetched", "duplicates", "unique", "relevant", "irrelevant", "inserted")))
