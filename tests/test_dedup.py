import random

import duckdb
import pandas as pd

from pyspark.sql import functions as F

from conftest import SF001, SF01
from curata.catalog.dedup import leader_ctes
from curata.functions.urls import with_identity
from curata.operators.dedup import (dedupe_within_batch, flag_cross_run, insert_or_ignore,
                                    winners_by_key)
from curata.sources.items import document_items, mixed_batch


def _frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, source_weight double, url_fp string, title_key string")


def leader_fold(rows):
    """{seq: is it a duplicate?} by the SQL statement of the rule."""
    keyed = pd.DataFrame(rows, columns=["seq", "source_weight", "url_fp", "title_key"]).astype(  # noqa: F841
        {"url_fp": "str", "title_key": "object"})
    told = duckdb.sql(f"WITH {leader_ctes()} SELECT seq, dup_at IS NOT NULL FROM told").fetchall()
    return dict(told)


def _check(spark, rows):
    got = {r.seq: r.batch_dup for r in dedupe_within_batch(_frame(spark, rows)).collect()}
    assert got == leader_fold(rows)


def test_same_url_heavier_wins(spark):
    rows = [(1, 1.0, "u", "a"), (2, 2.0, "u", "b")]
    got = {r.seq: r.batch_dup for r in dedupe_within_batch(_frame(spark, rows)).collect()}
    assert got == {1: True, 2: False}


def test_title_collapse_and_third_row_sharing_loser_title_survives(spark):
    # row 3 shares only the losing row's title: the loser never registered it
    rows = [(1, 2.0, "u1", "t1"), (2, 1.0, "u1", "t2"), (3, 1.0, "u3", "t2")]
    _check(spark, rows)
    got = {r.seq: r.batch_dup for r in dedupe_within_batch(_frame(spark, rows)).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_repointed_title_key(spark):
    rows = [(1, 1.0, "a", "x"), (2, 0.5, "b", "y"), (3, 2.0, "b", "x"), (4, 1.0, "c", "y"),
            (5, 3.0, "d", None), (6, 1.0, "d", "x"), (7, 1.0, "a", None)]
    _check(spark, rows)


def test_random_batches_match_fold(spark):
    rnd = random.Random(7)
    rows = []
    seq = 0
    for batch in range(30):
        for _ in range(rnd.randint(1, 12)):
            seq += 1
            rows.append((seq, rnd.choice([0.0, 0.5, 1.0, 1.5]),
                         f"u{batch}-{rnd.randint(0, 4)}",
                         rnd.choice([None, f"t{batch}-{rnd.randint(0, 3)}"])))
    _check(spark, rows)


def test_mixed_batch_sf001_matches_fold(spark):
    batch = with_identity(mixed_batch(document_items(spark, SF001)))
    rows = [(r.seq, r.source_weight, r.url_fp, r.title_key)
            for r in batch.select("seq", "source_weight", "url_fp", "title_key").collect()]
    got = {r.seq: r.batch_dup for r in dedupe_within_batch(batch).select("seq", "batch_dup").collect()}
    assert got == leader_fold(rows)


def test_mixed_batch_sf01_matches_fold(spark):
    batch = with_identity(mixed_batch(document_items(spark, SF01)))
    rows = [(r.seq, r.source_weight, r.url_fp, r.title_key)
            for r in batch.select("seq", "source_weight", "url_fp", "title_key").collect()]
    got = {r.seq: r.batch_dup for r in dedupe_within_batch(batch).select("seq", "batch_dup").collect()}
    exp = leader_fold(rows)
    assert got == exp
    assert sum(not d for d in exp.values()) < len(exp)


def test_winner_by_key(spark):
    df = _frame(spark, [(1, 1.0, "u", "t"), (2, 2.0, "u", "t"), (3, 2.0, "u", None)])
    got = {r.seq: r.is_winner for r in winners_by_key(df, "url_fp").collect()}
    assert got == {1: False, 2: True, 3: False}


def test_cross_run_probe(spark):
    archive = spark.createDataFrame([("a", "ta", "x")], "url_fp string, title_fp string, normalized_title string")
    batch = _frame(spark, [(1, 1.0, "a", None), (2, 1.0, "b", "ta"), (3, 1.0, "c", "zz")])
    got = {r.seq: r.cross_dup for r in flag_cross_run(batch, archive).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_insert_or_ignore(spark):
    batch = _frame(spark, [(1, 1.0, "a", None), (2, 1.0, "a", None), (3, 1.0, "b", None)])
    archived = spark.createDataFrame([("b",)], "k string")
    got = sorted(r.seq for r in insert_or_ignore(batch, archived).collect())
    assert got == [1]


def test_keys_of_a_batch_are_made_once(spark):
    """Verdicts read the keys many times; a batch's texts are cut and hashed for them once, and
    once more where the verdicts are joined to the rows."""
    from curata.operators.dedup import dedupe
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(x):
        made.add(1)
        return x
    rows = [(i, float(i % 3), f"u{i // 2}", f"t{i // 3}") for i in range(200)]
    batch = _frame(spark, rows).withColumn("title_key", key("title_key"))
    archive = spark.createDataFrame([("u1", "t9", "x")], "url_fp string, title_fp string, normalized_title string")
    got = {r.seq: r.dup_reason for r in dedupe(batch, archive).collect()}
    assert len(got) == 200 and got[2] is not None
    assert made.value <= 2 * len(rows)
