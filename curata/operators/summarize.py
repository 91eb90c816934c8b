"""Summary engines as DataFrame -> DataFrame functions.

An engine adds the draft columns ``what_changed``, ``why_it_matters``,
``comparison``, ``engine`` and ``model`` to a frame of summary inputs with the
columns ``item_id, title, summary, content, url`` and ``related``
(array<struct<related_item_id, related_title, related_url, related_summary, similarity>>).

``extractive`` is native Spark. Model answers are not fetched here: ``prompts``
writes the prompt table for offline batch inference and ``merge_answers`` joins
the answers back, falling back to the extractive draft per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions.text import col, sentences, strip_ws, top_sentences

DEFAULT_FOCUS = "the AI tooling space"

ANSWER_SCHEMA = T.StructType([
    T.StructField("what_changed", T.StringType()),
    T.StructField("why_it_matters", T.StringType()),
    T.StructField("comparison", T.StringType()),
])


def best_text(content="content", summary="summary") -> Column:
    """Stripped page text, else stripped feed summary."""
    c = strip_ws(F.coalesce(col(content), F.lit("")))
    return F.when(c != "", c).otherwise(strip_ws(F.coalesce(col(summary), F.lit(""))))


def why_it_matters(scope_name: str) -> Column:
    focus = scope_name or DEFAULT_FOCUS
    return F.lit(f"A concrete addition to {focus}: it changes what's available to "
                 f"builders today rather than being general commentary.")


def comparison_text(related="related") -> Column:
    r = col(related)
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.lit("- "), x["related_title"])), "\n")
    return F.when(F.coalesce(F.size(r), F.lit(0)) > 0,
                  F.concat(F.lit("Related prior coverage to compare against:\n"), lines)
                  ).otherwise(F.lit(""))


def assemble_body(title="title", what="what_changed", why="why_it_matters",
                  comparison="comparison") -> Column:
    """Markdown: title, then the sections that are non-empty, stripped."""
    why_c, cmp_c = F.coalesce(col(why), F.lit("")), F.coalesce(col(comparison), F.lit(""))
    parts = F.concat(
        F.lit("# "), F.coalesce(col(title), F.lit("")), F.lit("\n\n**What changed**\n\n"),
        F.coalesce(col(what), F.lit("")),
        F.when(why_c != "", F.concat(F.lit("\n\n**Why it matters**\n\n"), why_c)).otherwise(F.lit("")),
        F.when(cmp_c != "", F.concat(F.lit("\n\n**How it compares**\n\n"), cmp_c)).otherwise(F.lit("")))
    return strip_ws(parts)


def extracted(items: DataFrame, k: int = 3) -> DataFrame:
    """Adds ``what_changed``: the k most salient sentences of the best text in document order;
    else the summary; else the title. It needs nothing but the item."""
    summary = F.coalesce(F.col("summary"), F.lit(""))
    fallback = F.when(summary != "", summary).otherwise(F.coalesce(F.col("title"), F.lit("")))
    # materialised step by step: the whole text is split into sentences once per row
    staged = (items.withColumn("_sents", sentences(best_text()))
              .withColumn("_picked", top_sentences("_sents", k)).drop("_sents"))
    picked = F.col("_picked")
    return staged.withColumn("what_changed", F.when(
        F.size(picked) > 0, F.array_join(picked, " ")).otherwise(fallback)).drop("_picked")


def extractive(inputs: DataFrame, scope_name: str = "", k: int = 3) -> DataFrame:
    """The extractive engine: ``extracted`` (unless that has been done, so that the texts
    could be dropped before a join), the scope's sentence and the related titles."""
    staged = inputs if "what_changed" in inputs.columns else extracted(inputs, k)
    return staged.withColumns({
        "why_it_matters": why_it_matters(scope_name),
        "comparison": comparison_text("related"),
        "engine": F.lit("extractive"),
        "model": F.lit(""),
    })


def prompts(inputs: DataFrame, scope_name: str = "", text_chars: int | None = None,
            related_chars: int | None = None) -> DataFrame:
    """The prompt table (item_id, prompt) for batch inference (P31). ``text_chars`` and
    ``related_chars`` shorten the source text and the related summaries for a model with a
    small window; None keeps them whole."""
    def first(text, chars):
        return text if chars is None else F.substring(text, 1, chars)

    body = best_text()
    related = F.coalesce(F.col("related"), F.array())
    rel_lines = F.transform(related, lambda r: F.concat(
        F.lit("- "), r["related_title"],
        F.when(F.coalesce(r["related_summary"], F.lit("")) != "",
               F.concat(F.lit(" — "), first(r["related_summary"], related_chars)))
        .otherwise(F.lit(""))))
    parts = F.concat(
        F.lit("TITLE: "), F.col("title"), F.lit("\nSOURCE URL: "), F.col("url"),
        F.lit(f"\nBLOG FOCUS: {scope_name}") if scope_name else F.lit(""),
        F.when(body != "", F.concat(F.lit("\n\nSOURCE TEXT:\n"), first(body, text_chars)))
        .otherwise(F.lit("")),
        F.when(F.size(related) > 0, F.concat(
            F.lit("\n\nRELATED PRIOR ITEMS (for the comparison section):\n"), F.array_join(rel_lines, "\n")))
        .otherwise(F.lit("\n\nRELATED PRIOR ITEMS: none")))
    return inputs.select("item_id", parts.alias("prompt"))


def merge_answers(inputs: DataFrame, answers: DataFrame, scope_name: str = "",
                  model: str = "") -> DataFrame:
    """Model answer when present, not a refusal and a JSON object with the three
    string fields; otherwise the extractive draft (J8). ``answers``:
    (item_id, stop_reason, text). Adds ``fallback`` (an answer was expected but
    not usable)."""
    a = answers.select("item_id", F.col("stop_reason").alias("_stop"),
                       F.from_json("text", ANSWER_SCHEMA).alias("_ans"))
    j = extractive(inputs.join(a, "item_id", "left"), scope_name)
    valid = (F.coalesce(F.col("_stop"), F.lit("")) != "refusal") & F.col("_ans").isNotNull() \
        & F.col("_ans.what_changed").isNotNull() & F.col("_ans.why_it_matters").isNotNull() \
        & F.col("_ans.comparison").isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    return (j.withColumns({
                "what_changed": F.when(valid, strip_ws(F.col("_ans.what_changed"))).otherwise(F.col("what_changed")),
                "why_it_matters": F.when(valid, strip_ws(F.col("_ans.why_it_matters"))).otherwise(F.col("why_it_matters")),
                "comparison": F.when(valid, strip_ws(F.col("_ans.comparison"))).otherwise(F.col("comparison")),
                "engine": F.when(valid, F.lit("llm")).otherwise(F.lit("extractive")),
                "model": F.when(valid, F.lit(model)).otherwise(F.lit("")),
                "fallback": ~valid,
            })
            .drop("_stop", "_ans"))


# ------------------------------------------------------------------ engine registry
Engine = Callable[..., DataFrame]
ENGINES: dict[str, Engine] = {}


def register_engine(name: str):
    def deco(fn: Engine) -> Engine:
        ENGINES[name] = fn
        return fn
    return deco


register_engine("extractive")(extractive)


def build_engine(name: str) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"unknown summarizer type {name!r}; known types: {sorted(ENGINES)}")
    return ENGINES[name]
