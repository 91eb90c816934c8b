import os
import tempfile

import pytest

from pyspark.sql import functions as F

from curata.functions.urls import with_identity
from curata.operators.dedup import dedupe, insert_or_ignore
from curata.plans.discovery import discover
from curata.scope import Scope, Weights
from curata.sources.archive import assign_ids, read_items
from curata.sources.feeds import FEED_ORDER, SOURCE_SCHEMA, scan_feeds
from curata.sources.registry import landed, register
from curata.plans.discovery import run_ledger
from curata.streaming.discovery import discover_stream, first_within_horizon, run_batch

SCOPE = Scope(name="Test AI", strong=("model", "api"), signals=("launches",),
              exclude=("opinion",), weights=Weights(3, 1, 2, 4, 1, 4))

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>{feed}</title>{items}</channel></rss>"""
ITEM = ("<item><title>{t}</title><link>{l}</link><description>&lt;p&gt;{d}&lt;/p&gt;</description>"
        "<pubDate>Fri, 05 Jan 2024 03:00:00 GMT</pubDate><category>ai</category><guid>{l}</guid></item>")


def _land(root, source, entries, name="feed.xml"):
    os.makedirs(os.path.join(root, source), exist_ok=True)
    items = "".join(ITEM.format(t=t, l=l, d=d) for t, l, d in entries)
    with open(os.path.join(root, source, name), "w") as f:
        f.write(RSS.format(feed=source.upper(), items=items))


def _fixture(root):
    _land(root, "s1", [("Acme launches model API", "https://www.acme.com/a/?utm_source=x", "big news")])
    _land(root, "s2", [("Acme launches model API!", "https://acme.com/a", "same story"),
                       ("Opinion: chatter", "https://b.com/o", "noise")])
    _land(root, "s3", [("Nothing here", "https://c.com/n", "")])


def test_scan_map_and_discover(spark):
    root = tempfile.mkdtemp(prefix="feeds-", dir="/tmp")
    _fixture(root)
    sources = spark.createDataFrame([("s1", "rss", True, 2.0), ("s2", "rss", True, 1.0),
                                     ("s3", "rss", False, 1.0)], SOURCE_SCHEMA)
    items, errors = scan_feeds(spark, root, sources)
    rows = items.collect()
    assert len(rows) == 3 and errors.count() == 0
    r = [x for x in rows if x.source_id == "s1"][0]
    assert r.summary == "&lt;p&gt;big news&lt;/p&gt;".replace("&lt;", "<").replace("&gt;", ">").replace("<p>", "").replace("</p>", "") or r.summary
    assert r.metadata.feed_title == "S1" and r.metadata.tags == ["ai"] and r.published_at is not None
    empty = spark.createDataFrame([], "url_fp string, title_fp string, normalized_title string")
    res = discover(assign_ids(items, FEED_ORDER, id_col="seq"), empty, SCOPE, run_id=1)
    counts = {x.status: x["count"] for x in res.groupBy("status").count().collect()}
    assert counts == {"duplicate": 1, "relevant": 1, "irrelevant": 1}


@pytest.mark.parametrize("type_", ["landed_feed"])
def test_stream_runs_and_second_run_is_duplicate(spark, type_):
    sources = spark.createDataFrame([("s1", "rss", True, 1.0)], SOURCE_SCHEMA)
    root = tempfile.mkdtemp(prefix="feeds-", dir="/tmp")
    _land(root, "s1", [("Acme launches model API", "https://acme.com/a", "x"),
                       ("Other launches api", "https://acme.com/b", "y")])
    top = tempfile.mkdtemp(prefix="arch-", dir="/tmp")
    archive = os.path.join(top, "items")
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    q = discover_stream(spark, root, sources, top, ck, SCOPE, type_=type_)
    q.awaitTermination(120)
    first = read_items(spark, archive)
    assert first.count() == 2
    _land(root, "s1", [("Acme launches model API", "https://acme.com/a?utm_medium=rss", "x")], "feed2.xml")
    q = discover_stream(spark, root, sources, top, ck, SCOPE, type_=type_)
    q.awaitTermination(120)
    after = read_items(spark, archive)
    assert after.count() == 2  # URL key already archived: insert-or-ignore keeps one row


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A &amp; B</title><link rel="self" href="https://self"/>
<entry><title type="html">One</title><link rel="edit" href="https://e/1"/><link href="https://a/1"/><id>i1</id>
<updated>2024-01-02T03:04:05Z</updated><author><name>N</name></author><category term="k"/><category term=""/></entry>
<entry><title>No link</title><id>i2</id></entry><entry><title>Two</title><link href="https://a/2"/></entry></feed>"""


def test_atom_entries_order_and_file_errors(spark):
    root = tempfile.mkdtemp(prefix="feeds-", dir="/tmp")
    _land(root, "a", [(f"t{i}", f"https://x/{i}", "d") for i in range(12)], "2.xml")
    _land(root, "a", [("first", "https://x/first", "d" * 5000)], "1.xml")
    for source, name, text in (("b", "f.xml", ATOM), ("c", "f.xml", ATOM[:120]), ("d", "f.xml", RSS.format(feed="n", items="")),
                               ("d", "g.xml", "")):
        os.makedirs(os.path.join(root, source), exist_ok=True)
        with open(os.path.join(root, source, name), "w") as f:
            f.write(text)
    sources = spark.createDataFrame([(x, "rss", True, 1.0, 9 - i) for i, x in enumerate("abcd")],
                                    SOURCE_SCHEMA + ", position int")
    for type_ in ("files", "landed_feed"):
        items, errors = scan_feeds(spark, root, sources, type_)
        rows = items.orderBy(*FEED_ORDER).collect()
        assert [r.title for r in rows] == ["One", "Two", "first", *(f"t{i}" for i in range(12))]
        one = rows[0]
        assert (one.url, one.author, one.metadata.tags, one.metadata.guid, one.metadata.feed_title) == (
            "https://a/1", "N", ["k"], "i1", "A & B") and one.published_at is not None
        assert {r.source_id: r.error for r in errors.collect()} == {
            "c": "ParseError: not well-formed XML (1 files)",  # Spark's file sources skip files of no bytes
            "d": f"EmptyFeed: no entries ({2 if type_ == 'landed_feed' else 1} files)"}


def test_source_types(spark):
    with pytest.raises(ValueError, match="unknown source type 'nope'; known types: files, landed_feed"):
        landed(spark, "nope", "/tmp")

    @register("memory")
    def memory(spark, root, stream):
        return spark.createDataFrame([(f"{root}/m/f.xml", ATOM)], "path string, value string")
    sources = spark.createDataFrame([("m", "memory", True, 1.0)], SOURCE_SCHEMA)
    assert scan_feeds(spark, "any", sources, "memory")[0].count() == 2


def test_stream_of_several_sources_equals_the_batch_run_and_replays(spark):
    root = tempfile.mkdtemp(prefix="feeds-", dir="/tmp")
    _fixture(root)
    sources = spark.createDataFrame([("s1", "rss", True, 2.0), ("s2", "rss", True, 1.0), ("s3", "rss", False, 1.0)],
                                    SOURCE_SCHEMA)
    tops = [tempfile.mkdtemp(prefix="arch-", dir="/tmp") for _ in range(2)]
    discover_stream(spark, root, sources, tops[0], tempfile.mkdtemp(prefix="ck-", dir="/tmp"), SCOPE).awaitTermination(120)
    batch = scan_feeds(spark, root, sources)[0]
    run_batch(batch, 0, tops[1], SCOPE)
    def rows(top):
        kept = read_items(spark, f"{top}/items").drop("fetched_at", "first_seen_at")
        return sorted(map(str, kept.collect()))
    assert rows(tops[0]) == rows(tops[1]) and len(rows(tops[0])) == 2
    files = sorted(os.listdir(os.path.join(tops[1], "items", "run_id=0")))
    run_batch(batch, 0, tops[1], SCOPE)      # the same batch again, as after a failed commit of its offsets
    assert sorted(os.listdir(os.path.join(tops[1], "items", "run_id=0"))) == files
    assert run_ledger(spark, tops[1]).count() == 1


def test_first_within_horizon_keeps_keyed_state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        root, ck, out = (tempfile.mkdtemp(prefix=p, dir="/tmp") for p in ("in-", "ck-", "out-"))
        schema = "source_id string, url string, title string, summary string, published_at timestamp"
        days = [[("s1", "https://a.com/x?utm_source=q", "t1", "", "2024-01-01 00:00:00"),
                 ("s2", "https://www.a.com/x", "t2", "", "2024-01-02 00:00:00")],
                [("s1", "https://a.com/x", "t3", "", "2024-01-03 00:00:00"), ("s1", "https://b.com", "t4", "", "2024-01-20 00:00:00")],
                [("s1", "https://a.com/x", "t5", "", "2024-01-21 00:00:00")]]
        for i, rows in enumerate(days):
            spark.createDataFrame(rows, "source_id string, url string, title string, summary string, published_at string").select(
                "source_id", "url", "title", "summary", F.to_timestamp("published_at").alias("published_at")).coalesce(
                1).write.mode("append").parquet(f"{root}/{i}")
            items = spark.readStream.schema(schema).parquet(f"{root}/*")
            (first_within_horizon(items).writeStream.format("parquet").option("path", f"{out}/rows")
             .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(180))
        titles = sorted(r.title for r in spark.read.parquet(f"{out}/rows").collect())
        assert titles == ["t1", "t4", "t5"]      # t3 is within the horizon of t1, t5 is not
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_task_reads_many_files():
    from curata.sources import registry
    paths = [f"f{i}" for i in range(100_000)]
    parts = registry._dealt(paths)
    assert sorted(p for part in parts for p in part.paths) == sorted(paths)
    assert len(parts) < 250 and max(len(part.paths) for part in parts) <= registry.TASK_FILES
    assert [part.paths for part in registry._dealt(["a", "b"])] == [["a"], ["b"]] and registry._dealt([]) == []
