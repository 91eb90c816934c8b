"""Discovery as a Structured Streaming query.

Landed feed files of all enabled sources are read as a stream of whole files; each
micro-batch is one discovery run (``foreachBatch``): in-batch leader dedup, archive probes,
scoring, an insert-or-ignore append to the archive and a ledger row. The archive is the only
state, so a late item is compared with all of it. A batch that is replayed after its ledger
row was written does nothing; one that was cut off rewrites its own partition.

``first_within_horizon`` is the bounded-state alternative on the URL key alone: keyed state
with an event-time timer per key, for streams too large to probe an archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from curata.functions.urls import with_identity
from curata.plans.discovery import discovery_run
from curata.scope import Scope
from curata.session import ship_package
from curata.sources.archive import assign_ids
from curata.sources.feeds import FEED_ORDER, feed_entries, parse_feeds
from curata.sources.registry import landed


def feed_stream(spark: SparkSession, root: str, sources: DataFrame, type_: str = "files") -> DataFrame:
    """Items of the enabled sources' landed files as a stream, by a registered source type."""
    return feed_entries(parse_feeds(landed(spark, type_, root, stream=True)), sources)


def run_batch(batch: DataFrame, batch_id: int, archive_root: str, scope: Scope) -> None:
    """One micro-batch = one discovery run; items are taken in the order of their sources."""
    discovery_run(assign_ids(batch, FEED_ORDER, start=0, id_col="seq"), archive_root, scope, batch_id)


def discover_stream(spark: SparkSession, root: str, sources: DataFrame, archive_root: str,
                    checkpoint: str, scope: Scope, available_now: bool = True,
                    type_: str = "files") -> StreamingQuery:
    items = feed_stream(spark, root, sources, type_)
    w = items.writeStream.foreachBatch(lambda df, bid: run_batch(df, bid, archive_root, scope))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


class _FirstPerKey(StatefulProcessor):
    """Passes the first item of a key; forgets the key when its timer fires."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = pd.concat(list(rows)).sort_values(["published_at", "url"])
        if not self.seen.exists():
            first = items.iloc[:1]
            at = int(first["published_at"].iloc[0].value // 1_000_000)
            self.seen.update((at,))
            self.handle.registerTimer(at + self.horizon_ms)
            yield first[["url_fp", "source_id", "url", "title", "published_at"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        """Nothing is held outside the state store."""


def first_within_horizon(items: DataFrame, late: str = "1 day", horizon_days: int = 7) -> DataFrame:
    """The first item of each URL key, and again the first one after ``horizon_days`` of event
    time: weaker than the archive probe (URL key only, one horizon). Needs the RocksDB state
    store. Items without a date are left out; their key's state could never end."""
    ship_package(items.sparkSession)
    keyed = with_identity(items).where(F.col("published_at").isNotNull()).select(
        "url_fp", "source_id", "url", "title", "published_at").withWatermark("published_at", late)
    return keyed.groupBy("url_fp").transformWithStateInPandas(
        statefulProcessor=_FirstPerKey(horizon_days * 86_400_000),
        outputStructType="url_fp string, source_id string, url string, title string, published_at timestamp",
        outputMode="Append", timeMode="EventTime")
