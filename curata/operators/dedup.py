"""Deduplication: winner per key, in-batch leader dedup, cross-run dedup,
insert-or-ignore.

In-batch dedup (the leader rule) is order dependent: a row is a duplicate of an
already kept row if it shares the kept row's URL key or (non-empty) title key;
the strictly heavier source wins, ties keep the first; only rows that were kept at
some time register their keys, and a winning row re-points its title key. The plan:

1. connected components over the URL and title keys bound which rows interact;
2. components where every row shares one URL key, or every row has the same
   title key, reduce exactly to "heaviest, then first": decided by a partial
   aggregation (map-side combine, so a hot key is split across tasks);
3. the remaining (mixed) components are folded in ``seq`` order by
   ``mapInPandas`` over partitions hash-partitioned by component and sorted by
   (component, seq). The fold keeps only the registered keys in memory and
   streams the rows; it emits events, and the verdict per row is an aggregation
   of the events in Spark.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.operators.components import connected_components
from curata.session import ship_package, stored

# in-batch insert groups of the archive write: kept rows, then in-batch
# duplicates, then cross-run duplicates
GROUP_UNIQUE, GROUP_BATCH_DUP, GROUP_CROSS_DUP = 0, 1, 2


def winners_by_key(df: DataFrame, key: str, weight: str = "source_weight",
                   seq: str = "seq") -> DataFrame:
    """Adds ``is_winner``: per non-NULL key the heaviest row, ties to the lowest seq
    (rows with a NULL key win). The winner per key is a partial aggregation; the
    flag joins back on the unique ``seq``, so a hot key is never one task."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    best = (df.where(F.col(key).isNotNull())
            .groupBy(key).agg(F.min(F.struct((-w).alias("nw"), F.col(seq).alias("s"))).alias("b"))
            .select(F.col("b.s").alias("_win_seq")))
    return (df.join(best, F.col(seq) == F.col("_win_seq"), "left")
            .withColumn("is_winner", F.col(key).isNull() | F.col("_win_seq").isNotNull())
            .drop("_win_seq"))


# ------------------------------------------------------------------ leader fold
_EVENT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("slot", T.LongType()),
    T.StructField("kind", T.IntegerType()),   # 0 kept on arrival/win, 1 dup on arrival, 2 displaced
    T.StructField("at", T.LongType()),        # time (seq) of the event
])


_KEPT, _REJECTED, _DISPLACED = 0, 1, 2


class _Slots:
    """The kept slots of one component. A key names the slot of the row that last
    registered it; a slot has one holder, and only holders register keys."""

    def __init__(self):
        self.named: dict[tuple[str, str], int] = {}
        self.holder: dict[int, tuple[int, float]] = {}

    def admit(self, seq: int, weight: float, keys: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
        """Events (seq, slot, kind, at) that the arrival of a row causes."""
        slot = next((self.named[k] for k in keys if k in self.named), seq)
        held = self.holder.get(slot)
        if held is not None and weight <= held[1]:
            return [(seq, slot, _REJECTED, seq)]
        self.holder[slot] = (seq, weight)
        self.named.update(dict.fromkeys(keys, slot))
        lost = [(held[0], slot, _DISPLACED, seq)] if held is not None else []
        return [*lost, (seq, slot, _KEPT, seq)]


def _fold_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The leader rule over rows sorted by (component, seq); state is per component."""
    current, slots = None, _Slots()
    for rows in batches:
        events = []
        for row in rows.itertuples(index=False):
            if row.component != current:
                current, slots = row.component, _Slots()
            keys = [(kind, key) for kind, key in (("url", row.u), ("title", row.t)) if key is not None]
            events += slots.admit(int(row.seq), float(row.w), keys)
        yield pd.DataFrame(events, columns=["seq", "slot", "kind", "at"])


def _fold_mixed(mixed: DataFrame) -> DataFrame:
    """(component, seq, w, u, t) -> (seq, slot, dup, dup_at)."""
    ship_package(mixed.sparkSession)
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = (mixed.repartition(n, "component")
              .sortWithinPartitions("component", "seq")
              .mapInPandas(_fold_partition, _EVENT_SCHEMA))
    return (events.groupBy("seq")
            .agg(F.max("kind").alias("k"), F.max("at").alias("at"), F.max("slot").alias("slot"))
            .select("seq", "slot", (F.col("k") > 0).alias("dup"),
                    F.when(F.col("k") > 0, F.col("at")).alias("dup_at")))


def _decide_simple(simple: DataFrame) -> DataFrame:
    """Components whose rows share one URL key, or all carry the same title key:
    every row meets one slot, whose occupants are the successive strict weight
    records. (component, seq, w) -> (seq, slot, dup, dup_at).

    The first row of each weight value per component is a record candidate; a
    record is displaced by the first later row of a strictly greater weight. The
    per-(component, weight) table has at most one row per distinct weight (source
    weights come from the source table), so its window is small."""
    firsts = simple.groupBy("component", "w").agg(F.min("seq").alias("first_seq"))
    heavier = Window.partitionBy("component").orderBy(F.desc("w")).rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("heavier_first", F.min("first_seq").over(heavier))
    slot = simple.groupBy("component").agg(F.min("seq").alias("slot"))
    j = simple.join(firsts, ["component", "w"]).join(slot, "component")
    is_record = (F.col("seq") == F.col("first_seq")) & (
        F.col("heavier_first").isNull() | (F.col("heavier_first") > F.col("seq")))
    return j.select(
        "seq", "slot",
        (~is_record | F.col("heavier_first").isNotNull()).alias("dup"),
        F.when(~is_record, F.col("seq"))
         .when(F.col("heavier_first").isNotNull(), F.col("heavier_first")).alias("dup_at"))


def dedupe_within_batch(batch: DataFrame, seq: str = "seq", weight: str = "source_weight",
                        url_key: str = "url_fp", title_key: str = "title_key") -> DataFrame:
    """Adds ``batch_dup`` (bool), ``slot`` (seq of the row that opened the kept
    slot) and ``dup_at`` (seq at which the row became a duplicate) to ``batch``.
    ``seq`` must be unique within the batch."""
    decided = _decided(_batch_keys(batch, seq, weight, url_key, title_key))
    return (batch.join(decided.withColumnRenamed("seq", seq), seq)
            .withColumnRenamed("dup", "batch_dup"))


def _batch_keys(batch: DataFrame, seq: str, weight: str = "source_weight", url_key: str = "url_fp",
                title_key: str = "title_key") -> DataFrame:
    """(seq, w, u, t), written once: the verdicts read the keys many times, and each reading
    would cut, normalise and hash the texts of the batch again."""
    return stored(batch.select(F.col(seq).alias("seq"),
                               F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"),
                               F.col(url_key).alias("u"), F.col(title_key).alias("t")), "batch-keys")


def _decided(keys: DataFrame) -> DataFrame:
    """(seq, slot, dup, dup_at) of the rows of ``_batch_keys``, written once."""
    comp = connected_components(keys.select("seq", "u", "t"), "seq", ["u", "t"])
    rows = stored(keys.join(comp, "seq"), "batch-components")
    stats = rows.groupBy("component").agg(
        F.count_distinct("u").alias("n_u"), F.count_distinct("t").alias("n_t"),
        F.count_if(F.col("t").isNull()).alias("n_null_t"))
    rows = rows.join(stats, "component")
    is_simple = (F.col("n_u") == 1) | ((F.col("n_t") == 1) & (F.col("n_null_t") == 0))
    return stored(_decide_simple(rows.where(is_simple).select("component", "seq", "w")).unionByName(
        _fold_mixed(rows.where(~is_simple).select("component", "seq", "w", "u", "t"))), "batch-verdicts")


# ------------------------------------------------------------------ cross-run
def archive_keys(archive: DataFrame, url_key: str = "url_fp", title_key: str = "title_fp",
                 normalized_title: str = "normalized_title") -> tuple[DataFrame, DataFrame]:
    """Distinct URL keys and distinct non-empty title keys of the archive (two
    one-column scans; the rest of the archive is pruned)."""
    urls = archive.select(F.col(url_key).alias("_ak")).distinct()
    titles = (archive.where(F.col(normalized_title) != "")
              .select(F.col(title_key).alias("_ak")).distinct())
    return urls, titles


def flag_cross_run(batch: DataFrame, archive: DataFrame, url_key: str = "url_fp",
                   title_key: str = "title_key") -> DataFrame:
    """Adds ``cross_dup``: the URL key is archived, or the non-empty title key is
    (whatever the archived row's status). Two left-semi probes, as flags."""
    urls, titles = archive_keys(archive)
    hit_u = batch.select(url_key).distinct().join(
        urls, F.col(url_key) == F.col("_ak"), "left_semi").withColumn("_hu", F.lit(True))
    hit_t = batch.where(F.col(title_key).isNotNull()).select(title_key).distinct().join(
        titles, F.col(title_key) == F.col("_ak"), "left_semi").withColumn("_ht", F.lit(True))
    return (batch.join(hit_u, url_key, "left").join(hit_t, title_key, "left")
            .withColumn("cross_dup", F.coalesce(F.col("_hu"), F.lit(False))
                        | F.coalesce(F.col("_ht"), F.lit(False)))
            .drop("_hu", "_ht"))


def dedupe(batch: DataFrame, archive: DataFrame, seq: str = "seq") -> DataFrame:
    """Full dedup: in-batch leader, then archive probes for the kept rows.
    Adds status_dedup in ('unique', 'duplicate'), ``dup_reason`` and
    ``insert_group`` / ``insert_at`` giving the archive insert order."""
    keys = _batch_keys(batch, seq)
    decided = _decided(keys)
    # verdicts are made of keys alone; the texts of the batch are joined to them once
    flags = flag_cross_run(keys.select("seq", "u", "t").distinct(), archive, "u", "t").groupBy("seq").agg(
        F.max("cross_dup").alias("cross_dup"))
    verdict = decided.join(flags, "seq").withColumnRenamed("dup", "batch_dup")
    flagged = batch.join(verdict.withColumnRenamed("seq", seq), seq)
    cross = ~F.col("batch_dup") & F.col("cross_dup")
    return (flagged
            .withColumn("dup_reason", F.when(F.col("batch_dup"), F.lit("batch"))
                        .when(cross, F.lit("archive")))
            .withColumn("status_dedup", F.when(F.col("dup_reason").isNull(), F.lit("unique"))
                        .otherwise(F.lit("duplicate")))
            .withColumn("insert_group", F.when(F.col("batch_dup"), F.lit(GROUP_BATCH_DUP))
                        .when(cross, F.lit(GROUP_CROSS_DUP)).otherwise(F.lit(GROUP_UNIQUE)))
            .withColumn("insert_at", F.when(F.col("batch_dup"), F.col("dup_at"))
                        .otherwise(F.col("slot"))))


# ------------------------------------------------------------------ insert-or-ignore
def insert_or_ignore(batch: DataFrame, archive_url_keys: DataFrame | None,
                     url_key: str = "url_fp", order: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` that an insert-or-ignore on the URL key would store: the
    first row per key in insert order, and none whose key is already archived.
    The first row per key is a partial aggregation over a struct of the order
    columns (a hot key is combined map-side), joined back on the order key."""
    order = order or ["seq"]
    first = (batch.groupBy(url_key)
             .agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first")))
    for i, c in enumerate(order):
        first = first.withColumn(f"_o{i}", F.col("_first")[c])
    first = first.drop("_first")
    if archive_url_keys is not None:
        first = first.join(archive_url_keys.select(F.col(archive_url_keys.columns[0]).alias(url_key)),
                           url_key, "left_anti")
    cond = [batch[url_key] == first[url_key]] + [batch[c] == first[f"_o{i}"] for i, c in enumerate(order)]
    return batch.join(first, cond, "left_semi")


def flag_earlier_runs(items: DataFrame, run_col: str = "run_id", url_key: str = "url_fp",
                      title_key: str = "title_key") -> DataFrame:
    """Cross-run dedup for a whole run history at once: an item is an archive
    duplicate when its URL key, or its non-empty title key, occurs in an earlier
    run. First run per key is a partial aggregation over (key, run); the flags
    join back on the key (one row per key on the build side)."""
    first_u = items.groupBy(url_key).agg(F.min(run_col).alias("_fu"))
    first_t = (items.where(F.col(title_key).isNotNull())
               .groupBy(title_key).agg(F.min(run_col).alias("_ft")))
    return (items.join(first_u, url_key, "left").join(first_t, title_key, "left")
            .withColumn("cross_dup", F.coalesce(F.col("_fu") < F.col(run_col), F.lit(False))
                        | F.coalesce(F.col("_ft") < F.col(run_col), F.lit(False)))
            .drop("_fu", "_ft"))
