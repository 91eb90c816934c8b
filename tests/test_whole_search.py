"""Queries whose related priors cover every relevant item, against their SQL."""
import os

import duckdb
import pytest

import __spark_entry__ as driver
from conftest import SF001
from tools.oracle_check import digest

@pytest.mark.parametrize("name", ["articles", "quality_gate", "extractive_summary", "prompt_table", "cosine_pairs"])
def test_every_item_is_compared(spark, name):
    sql = driver.oracle_sql()[name]
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    want = con.execute(sql)
    columns, rows = [d[0] for d in want.description], want.fetchall()
    got = driver.queries()[name](spark, SF001)
    assert len(rows) > 1
    assert digest(got.columns, [tuple(r) for r in got.collect()]) == digest(columns, rows)
