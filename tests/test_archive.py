from pyspark.sql import functions as F

from curata.sources.archive import assign_ids, read_items, write_items


def test_assign_ids_keeps_every_wide_row(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = (spark.range(0, 40_000, 1, 64).withColumn("key", F.xxhash64("id"))
                .withColumn("body", F.repeat(F.sha2(F.col("id").cast("string"), 256), 40)).drop("id"))
        out = str(tmp_path / "ids")
        assign_ids(rows, ["key"], id_col="n").write.parquet(out)
        got = spark.read.parquet(out)
        assert got.count() == 40_000
        assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 40_000, 40_000)
        ordered = [r.key for r in got.orderBy("n").limit(500).collect()]
        assert ordered == sorted(ordered)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_written_items_read_back_with_every_column(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = spark.createDataFrame([(3, "s", "https://e.org/a", "t")], "run_id long, source_id string, url string, title string")
    write_items(rows, path)
    got = read_items(spark, path).collect()
    assert len(got) == 1 and got[0].title == "t" and got[0].item_id is None and got[0].content == ""
    assert read_items(spark, path, before_run=3).count() == 0
