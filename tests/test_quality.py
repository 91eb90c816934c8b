from pyspark.sql import functions as F

from curata.operators.quality import check
from curata.operators.summarize import assemble_body

SRC = "array<struct<url:string,title:string,source_id:string,is_primary:boolean>>"
GOOD = " ".join(["word"] * 50)


def _drafts(spark, rows):
    df = spark.createDataFrame(rows, f"title string, what_changed string, why_it_matters string, "
                                     f"comparison string, sources {SRC}")
    return df.withColumn("body", assemble_body())


def _one(spark, row, **kw):
    return check(_drafts(spark, [row]), **kw).first()


def test_pass(spark):
    r = _one(spark, ("T", GOOD, "Because.", "", [("u", "t", "s", True)]))
    assert r.quality_status == "pass" and r.quality_issues == []


def test_missing_sources_fails(spark):
    assert _one(spark, ("T", GOOD, "Because.", "", [])).quality_status == "fail"


def test_short_fails(spark):
    r = _one(spark, ("T", "tiny", "Because.", "", [("u", "t", "s", True)]))
    assert r.quality_status == "fail" and r.quality_issues[0].startswith("too short (")


def test_refusal_fails_with_quoting(spark):
    r = _one(spark, ("T", GOOD + " I can't do that", "Because.", "", [("u", "t", "s", True)]))
    assert r.quality_status == "fail"
    assert "placeholder/refusal text: \"i can't\"" in r.quality_issues


def test_comparison_required_flags(spark):
    r = _one(spark, ("T", GOOD, "Because.", "", [("u", "t", "s", True)]), require_comparison=True)
    assert r.quality_status == "flagged" and r.quality_issues == ["missing comparison section"]


def test_bounds_inclusive(spark):
    df = _drafts(spark, [("T", GOOD, "", "", [("u", "t", "s", True)])])
    wc = check(df).first().word_count
    assert check(df, min_words=wc, max_words=wc).first().quality_issues == ["empty 'why it matters'"]
