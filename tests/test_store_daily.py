import pytest
from pyspark.sql import functions as F

from curata.plans import daily
from curata.scope import Scope, Weights
from curata.sources.store import ArticleStore

SCOPE = Scope(name="Test AI", strong=("model", "api"), signals=("launches",), exclude=("opinion",),
              weights=Weights(3, 1, 2, 4, 1, 4))
DRAFT = ("item_id bigint, title string, url string, source_id string, what_changed string, why_it_matters string, "
         "comparison string, body string, scope_tags array<string>, engine string, model string, quality_status string, "
         "quality_issues array<string>, word_count int, fallback boolean, "
         "sources array<struct<url:string,title:string,source_id:string,is_primary:boolean>>, "
         "comparisons array<struct<related_item_id:bigint,related_title:string,related_url:string,similarity:double,note:string>>")


def _drafts(spark, items):
    rows = [(i, f"t{i}", f"u{i}", "s", "w", "y", "", "b", ["x"], "extractive", "", "pass" if i % 2 else "fail", [], 50, True,
             [("v", "second", "s", False), (f"u{i}", f"t{i}", "s", True)],
             [(7, "r7", "u7", 0.2, ""), (9, "r9", "u9", 0.4, "")]) for i in items]
    return spark.createDataFrame(rows, DRAFT)


def test_articles_with_children_are_committed_once(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "store"))
    assert store.articles().count() == 0 and store.commits().count() == 0
    first = store.append(_drafts(spark, [5, 3]), 1, "2024-06-01 00:00:00", {"considered": 2})
    assert first == {"generated": 2, "passed": 2, "flagged": 0, "failed_quality": 0, "llm_fallbacks": 2, "considered": 2}
    assert store.append(_drafts(spark, [3, 4, 5]), 2, "2024-06-02 00:00:00")["generated"] == 1
    assert store.append(_drafts(spark, [8]), 2, "2024-06-02 00:00:00")["generated"] == 0    # a committed run stays as it is
    assert {r.article_id: r.item_id for r in store.articles().collect()} == {1: 3, 2: 5, 3: 4}
    one = store.article(2).collect()
    assert len(one) == 1 and [s.is_primary for s in one[0].sources] == [True, False]
    assert [c.related_item_id for c in one[0].comparisons] == [9, 7]
    assert [r.article_id for r in store.recent(2).collect()] == [3, 2]
    items = spark.createDataFrame([(3,), (99,)], "item_id bigint")
    assert {r.item_id: r.has_article for r in store.has_article(items).collect()} == {3: True, 99: False}
    with pytest.raises(ValueError, match="item 8 has more than one draft"):
        store.append(_drafts(spark, [8, 8]), 3, "2024-06-03 00:00:00")


def test_a_run_without_its_commit_shows_nothing_and_is_overwritten(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "store"))
    store.append(_drafts(spark, [1]), 1, "2024-06-01 00:00:00")
    rows = store.articles().withColumns({"article_id": F.lit(50), "item_id": F.lit(50), "run_id": F.lit(2)})
    store._write(rows, "articles", "article_id bigint, item_id bigint, title string, run_id bigint")   # cut off before its commit
    assert [r.item_id for r in store.articles().collect()] == [1]
    store.append(_drafts(spark, [2]), 2, "2024-06-02 00:00:00")
    assert sorted((r.article_id, r.item_id) for r in store.articles().collect()) == [(1, 1), (2, 2)]
    plan = store.articles().where("article_id = 2")._jdf.queryExecution().toString()
    assert "EqualTo(article_id,2)" in plan


def test_daily_run_reports_a_failure(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "run")
    batch = spark.createDataFrame(
        [(1, "s", "https://a.com/1", "Acme launches model API", "big news", 2.0), (2, "s", "https://a.com/2", "Nothing", "", 1.0)],
        "seq bigint, source_id string, url string, title string, summary string, source_weight double").withColumn(
        "published_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    landed = spark.createDataFrame([], "url_fp string, content string, content_fetched_at timestamp")
    good = daily.run_daily(batch, landed, root, SCOPE, 1, "2024-01-02 00:00:00")
    assert good["ok"] and good["discovery"]["relevant"] == 1 and good["generation"]["generated"] == 1
    def broken(*args, **kwargs):
        raise OSError("disk full")
    monkeypatch.setattr(daily, "publish", broken)
    bad = daily.run_daily(batch, landed, root, SCOPE, 2, "2024-01-03 00:00:00")
    assert not bad["ok"] and bad["discovery"]["duplicates"] == 2 and bad["generation"]["generated"] == 0
    told = {r.run_id: (r.health.status, r.health.summary) for r in daily.run_status(spark, root).collect()}
    assert told == {1: ("ok", "published/updated 1 article(s) from 1 relevant item(s)"),
                    2: ("failure", "pipeline failed: OSError: disk full")}


def test_drafts_are_numbered_where_they_are_written(spark, tmp_path):
    """Dense ids over many parts, none for a draft without an item; no row moves after the drafts are
    written, and these are gone when the run is committed."""
    from curata.session import ensure_checkpoint_dir
    from curata.sources import store as S
    drafts = _drafts(spark, range(100, -1, -1)).withColumn("item_id", F.nullif("item_id", F.lit(0))).repartition(5)
    store = ArticleStore(spark, str(tmp_path / "store"))
    where = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    files = lambda: {f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
                     if f.getPath().getName().startswith("drafts-")}
    before = files()
    store.append(drafts, 1, "2024-06-01 00:00:00")
    assert files() == before
    # a draft without an item takes a number, as before
    assert sorted((r.article_id, r.item_id) for r in store.articles().collect()) == [(i + 1, i) for i in range(1, 101)]
    assert store.sources().count() == 200 and store.commits().first().stats["generated"] == 100
    written = drafts.withColumn("_at", F.monotonically_increasing_id())
    written.write.parquet(str(tmp_path / "written"))
    plan = S._numbered(spark.read.parquet(str(tmp_path / "written")), 1)._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert "BroadcastHashJoin" in plan and len(wide) == 2        # of the rows counted by part


def test_the_store_writes_no_texts(spark):
    """The items of the drafts are scored where they are read; their rows are those written otherwise."""
    from conftest import SF001
    from curata.catalog import shared
    shared.forget()
    store = shared.article_store(spark, SF001)
    names = {name for _, _, name in shared._WRITTEN}
    assert names == {"draft-parts", "related-pairs", "article-store"}
    fresh, want = shared.read_items(spark, SF001), shared.relevant_items(spark, SF001)
    assert fresh.columns == want.columns and store.articles().count() == want.count()
    assert fresh.exceptAll(want).count() == 0 and want.exceptAll(fresh).count() == 0
    shared.forget()
