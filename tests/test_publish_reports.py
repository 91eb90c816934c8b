import datetime as dt

from pyspark.sql import functions as F

from curata.operators.publish import (json_feed, json_feed_items, published_articles, rss_items,
                                      search_index, text_blocks, view)
from curata.operators.reports import alert, health, status_counts

ART = ("article_id long, item_id long, title string, what_changed string, why_it_matters string, "
       "comparison string, scope_tags array<string>, engine string, quality_status string, "
       "created_at timestamp, sources array<struct<url:string,title:string,source_id:string,is_primary:boolean>>, "
       "comparisons array<struct<related_item_id:long,related_title:string,related_url:string,similarity:double,note:string>>")


def _site(spark):
    t = dt.datetime(2024, 1, 5, 3, 0, 0)
    arts = spark.createDataFrame([
        (1, 10, "Good & new", "What <changed>", "Why", "", ["Scope", "api"], "extractive", "pass", t,
         [("https://a/x", "x", "s1", True)], []),
        (2, 11, "Bad", "w", "y", "", [], "extractive", "fail", t, [("https://a/y", "y", "s1", True)], []),
    ], ART)
    items = spark.createDataFrame([(10, None, "s1", "https://a/x"), (11, t, "s1", "https://a/y")],
                                  "item_id long, published_at timestamp, source_id string, url string")
    return view(published_articles(arts, items))


def test_publish_gate(spark):
    v = _site(spark)
    assert [r.article_id for r in v.collect()] == [1]


def test_text_blocks(spark):
    df = spark.createDataFrame([("Header line\n- one\n- two\n\nAfter",)], "t string")
    blocks = df.select(text_blocks(F.col("t")).alias("b")).first().b
    assert [tuple(b) for b in blocks] == [("paragraph", "Header line", []), ("list", "", ["one", "two"]),
                                          ("paragraph", "After", [])]


def test_feeds_absolute_urls_and_escape(spark):
    v = _site(spark)
    rss = rss_items(v, "https://site.example/").first().item
    assert "<link>https://site.example/posts/1.html</link>" in rss and "Good &amp; new" in rss
    assert "<pubDate>Fri, 05 Jan 2024 03:00:00 +0000</pubDate>" in rss
    items = json_feed_items(v, "https://site.example")
    doc = json_feed(items, "T", "D", "https://site.example").first().value
    assert '"version":"https://jsonfeed.org/version/1.1"' in doc and "posts/1.html" in doc


def test_search_index_lower_text(spark):
    r = search_index(_site(spark)).first()
    assert r.text == r.text.lower() and r.source == "s1"


def test_health_verdicts(spark):
    df = spark.createDataFrame([(True, None, 5, 0, 2, 1), (True, None, 5, 0, 0, 0),
                                (True, None, 0, 3, 0, 0), (False, "Boom", 5, 0, 1, 1)],
                               "ok boolean, error string, fetched long, errs int, relevant long, generated long")
    h = df.select(health(F.col("ok"), F.col("error"), F.col("fetched"), F.col("errs"),
                         F.col("relevant"), F.col("generated")).alias("h")).collect()
    assert [r.h.status for r in h] == ["ok", "empty_news", "failure", "failure"]
    assert h[3].h.summary == "pipeline failed: Boom"


def test_alert_text(spark):
    df = spark.createDataFrame([("failure", "pipeline failed: Boom", ["a"], "Boom")],
                               "status string, summary string, srcs array<string>, error string")
    a = df.select(alert(F.col("status"), F.col("summary"), F.lit(1), F.lit(0), F.lit(0), F.col("srcs"),
                        F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.col("error"),
                        "https://ci/run/1").alias("a")).first().a
    assert "failure" in a.title and "Boom" in a.body and "https://ci/run/1" in a.body
    assert "- source errors: ['a']" in a.body


def test_status_counts_zero_filled(spark):
    df = spark.createDataFrame([("relevant",), ("irrelevant",)], "status string")
    got = {r.status: r.n for r in status_counts(df).collect()}
    assert got == {"new": 0, "relevant": 1, "irrelevant": 1, "duplicate": 0, "total": 2}
