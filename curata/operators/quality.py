"""Quality gate (C8): ordered issues and a verdict, one projection.

fail    missing sources; empty what-changed; too short; placeholder text; empty title
flagged empty why-it-matters; too long; missing comparison when required
pass    no issue
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.text import col, strip_ws, word_count

# --- fixed values: placeholder / refusal markers, tested in this order ---
PLACEHOLDER_MARKERS = ("i cannot", "i can't", "as an ai", "i'm sorry", "i am sorry",
                       "unable to summarize", "no content", "lorem ipsum")


def _quoted(marker: str) -> str:
    return repr(marker)  # single quotes, double quotes when the marker has an apostrophe


def first_marker(body) -> Column:
    low = F.lower(F.coalesce(col(body), F.lit("")))
    out = None
    for m in reversed(PLACEHOLDER_MARKERS):
        out = F.when(low.contains(m), F.lit(m)).otherwise(out if out is not None else F.lit(None))
    return out


def check(drafts: DataFrame, min_words: int = 40, max_words: int = 320,
          require_comparison: Column | bool = False, body: str = "body",
          sources: str = "sources") -> DataFrame:
    """Adds quality_status, quality_issues (array<string>) and word_count."""
    req = require_comparison if isinstance(require_comparison, Column) else F.lit(bool(require_comparison))
    wc = word_count(body)
    marker = first_marker(body)
    no_sources = F.coalesce(F.size(col(sources)), F.lit(0)) <= 0
    empty_what = strip_ws(F.coalesce(F.col("what_changed"), F.lit(""))) == ""
    empty_why = strip_ws(F.coalesce(F.col("why_it_matters"), F.lit(""))) == ""
    empty_title = strip_ws(F.coalesce(F.col("title"), F.lit(""))) == ""
    no_cmp = req & (strip_ws(F.coalesce(F.col("comparison"), F.lit(""))) == "")
    df = drafts.withColumn("word_count", wc).withColumn("_marker", marker)
    short = F.col("word_count") < min_words
    long_ = F.col("word_count") > max_words
    issues = F.array_compact(F.array(
        F.when(no_sources, F.lit("missing sources")),
        F.when(empty_what, F.lit("empty 'what changed'")),
        F.when(empty_why, F.lit("empty 'why it matters'")),
        F.when(short, F.format_string(f"too short (%d words < {min_words})", F.col("word_count")))
         .when(long_, F.format_string(f"too long (%d words > {max_words})", F.col("word_count"))),
        F.when(F.col("_marker").isNotNull(),
               F.concat(F.lit("placeholder/refusal text: "),
                        F.coalesce(*[F.when(F.col("_marker") == m, F.lit(_quoted(m)))
                                     for m in PLACEHOLDER_MARKERS]))),
        F.when(empty_title, F.lit("empty title")),
        F.when(no_cmp, F.lit("missing comparison section")),
    ))
    fail = no_sources | empty_what | short | F.col("_marker").isNotNull() | empty_title
    return (df.withColumn("quality_issues", issues)
            .withColumn("quality_status", F.when(fail, F.lit("fail"))
                        .when(F.size("quality_issues") > 0, F.lit("flagged")).otherwise(F.lit("pass")))
            .drop("_marker"))
