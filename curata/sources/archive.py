"""The Parquet archive: items, runs, articles and their children, content cache.

Tables are directories of Parquet files with fixed schemas, partitioned by
``run_id``; a run overwrites only its own partition (dynamic partition overwrite),
so a retried run is idempotent and readers of earlier runs are unaffected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.session import materialize

ITEM_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("normalized_url", T.StringType()),
    T.StructField("url_fp", T.StringType()),
    T.StructField("title_fp", T.StringType()),
    T.StructField("normalized_title", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("relevance_score", T.DoubleType()),
    T.StructField("relevance_reasons", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("source_weight", T.DoubleType()),
])

# columns added after the first schema version, with their defaults
ITEM_METADATA = T.StructType([
    T.StructField("feed_title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("source_weight", T.DoubleType()), T.StructField("guid", T.StringType())])
ITEM_ADDED_COLUMNS = {"content": (T.StringType(), ""), "content_fetched_at": (T.TimestampType(), None),
                      "metadata": (ITEM_METADATA, None), "first_seen_at": (T.TimestampType(), None)}


def read_items(spark: SparkSession, path: str, before_run: int | None = None) -> DataFrame:
    """Archive scan with the current schema: partitions pruned to runs before
    ``before_run``; columns missing in old files get their defaults (W4)."""
    schema = T.StructType(list(ITEM_SCHEMA.fields) + [
        T.StructField(k, t) for k, (t, _) in ITEM_ADDED_COLUMNS.items()])
    df = spark.read.schema(schema).option("mergeSchema", "true").parquet(path)
    if before_run is not None:
        df = df.where(F.col("run_id") < before_run)
    for k, (_, default) in ITEM_ADDED_COLUMNS.items():
        if default is not None:
            df = df.withColumn(k, F.coalesce(F.col(k), F.lit(default)))
    return df


def write_items(rows: DataFrame, path: str, version: int = 2) -> None:
    """Append one run's rows, replacing only that run's partition. Version 1 of the schema has
    no added columns."""
    added = {k: t for k, (t, _) in ITEM_ADDED_COLUMNS.items()} if version > 1 else {}
    types = {f.name: f.dataType for f in ITEM_SCHEMA.fields} | added
    out = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
                        for c, t in types.items()])
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def build_content_cache(pages: DataFrame, fetched_at=None) -> DataFrame:
    """One content per URL key, the first landed page's text (fetched once):
    (url_fp, content, content_fetched_at). ``min_by`` is a partial aggregate."""
    ts = F.lit(fetched_at).cast("timestamp") if fetched_at is not None else F.current_timestamp()
    return (pages.where(F.coalesce(F.col("content"), F.lit("")) != "")
            .groupBy("url_fp").agg(F.min_by("content", "item_id").alias("content"))
            .withColumn("content_fetched_at", ts))


def uncached(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items whose URL key has no cached content yet (the fetch candidates)."""
    return items.join(cache.select("url_fp"), "url_fp", "left_anti")


def with_cached_content(items: DataFrame, cache: DataFrame) -> DataFrame:
    return items.join(cache.select("url_fp", "content", "content_fetched_at"), "url_fp", "left")


def assign_ids(rows: DataFrame, order: list[str], start: int = 1, id_col: str = "id",
               written: bool = False) -> DataFrame:
    """Dense ids in ``order`` (columns that are unique together) without a
    single-partition window (W3). The rows and, range-sorted, their keys with the number
    of the sorted partition are each written once to the checkpoint folder; counts,
    offsets (one small row per partition) and positions come from that one table of keys,
    and the id joins back on the unique key, so no row can meet a partition other than
    the one it was counted in."""
    rows = rows if written else materialize(rows)   # ``written``: already read from files
    return rows.join(dense_ids(rows, order, start, id_col), order)


def dense_ids(rows: DataFrame, order: list[str], start: int = 1, id_col: str = "id") -> DataFrame:
    """(the columns ``order``, id) of ``assign_ids``, which the caller joins to the rows."""
    keys = materialize(rows.select(*order).orderBy(*order).withColumn("_pid", F.spark_partition_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keys.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    place = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return (keys.withColumn("_rn", place).join(offsets, "_pid")
            .select(*order, (F.col("_off") + F.col("_rn") + F.lit(start - 1)).cast("bigint").alias(id_col)))
