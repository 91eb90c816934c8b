"""Relevance scoring against an editorial scope (one narrow projection).

score = strong*w_s + normal*w_n + signals*w_a - exclude*w_x + source_weight*scale
relevant <=> unrounded score >= min_score and (a strong hit or a signal hit).

All hit lists are native ``rlike`` tests; no shuffle, the operator is a
``Project`` inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.keywords import keyword_hits, known_words, term_key, term_tokens
from curata.functions.text import scoring_text
from curata.scope import Scope

HIT_COLUMNS = ("strong_hits", "normal_hits", "signal_hits", "exclude_hits")


def _fmt_double(c: Column) -> Column:
    return c.cast("string")


def _hits_phrase(label: str, hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.concat(F.lit(label + ": "), F.array_join(hits, ", ")))


def add_keyword_hits(items: DataFrame, scope: Scope, text: Column | None = None) -> DataFrame:
    t = text if text is not None else scoring_text("title", "summary")
    known = F.col("_words")
    # of the words of a text, those that some keyword has, found once for all lists
    return items.withColumn("_words", known_words(t, (*scope.strong, *scope.normal, *scope.signals, *scope.exclude))).withColumns({
        "strong_hits": keyword_hits(t, scope.strong, known),
        "normal_hits": keyword_hits(t, scope.normal, known),
        "signal_hits": keyword_hits(t, scope.signals, known),
        "exclude_hits": keyword_hits(t, scope.exclude, known),
    }).drop("_words")


def score(items: DataFrame, scope: Scope, weight_col: str = "source_weight") -> DataFrame:
    """Adds the four hit lists, relevance_score (rounded to 3), relevant,
    relevance_reasons (ordered) and the unrounded score ``raw_score``."""
    w = scope.weights
    df = add_keyword_hits(items, scope)
    sw = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    raw = (F.size("strong_hits") * F.lit(w.strong_keyword)
           + F.size("normal_hits") * F.lit(w.normal_keyword)
           + F.size("signal_hits") * F.lit(w.announcement_signal)
           - F.size("exclude_hits") * F.lit(w.exclude_penalty)
           + sw * F.lit(w.source_weight_scale))
    in_scope = (F.size("strong_hits") + F.size("signal_hits")) > 0
    df = df.withColumns({"raw_score": raw, "_in_scope": in_scope, "_sw": sw})
    reasons = F.array_compact(F.array(
        _hits_phrase("strong", F.col("strong_hits")),
        _hits_phrase("novelty", F.col("signal_hits")),
        _hits_phrase("normal", F.col("normal_hits")),
        _hits_phrase("excluded", F.col("exclude_hits")),
        F.when(F.col("_sw") != 0, F.concat(F.lit("source_weight: "), _fmt_double(F.col("_sw")))),
        F.when(~F.col("_in_scope"), F.lit("no in-scope signal (dropped)")),
        F.concat(F.lit("score="), _fmt_double(F.round("raw_score", 2)),
                 F.lit(f" min={w.min_score!r}")),
    ))
    return (df.withColumns({
                "relevance_score": F.round("raw_score", 3),
                "relevant": (F.col("raw_score") >= F.lit(w.min_score)) & F.col("_in_scope"),
                "relevance_reasons": reasons,
            })
            .drop("_in_scope", "_sw"))


def apply_relevance(items: DataFrame, scope: Scope, weight_col: str = "source_weight") -> DataFrame:
    """Verdict written back: relevance_score, relevance_reasons, status."""
    return (score(items, scope, weight_col)
            .withColumn("status", F.when(F.col("relevant"), F.lit("relevant"))
                        .otherwise(F.lit("irrelevant"))))


def scope_tags(scope: Scope, k: int = 5, hits: Column | None = None) -> Column:
    """Scope name (if any) then the first k strong hits (those of ``score`` unless given)."""
    head = F.array(F.lit(scope.name)) if scope.name else F.array().cast("array<string>")
    return F.concat(head, F.slice(F.col("strong_hits") if hits is None else hits, 1, k))


def vocabulary(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, key, size) of a vocabulary for ``dictionary_hits``."""
    keys = [(t, term_key(t)) for t in dict.fromkeys(terms)]
    odd = [t for t, k in keys if k is None]
    if odd:
        raise ValueError(f"terms that need a pattern: {odd}")
    return spark.createDataFrame(keys, "term string, key string").withColumn("size", F.size(term_tokens("key")))


_SENT_TERMS = 1 << 18            # terms of a vocabulary, at most, that each executor is sent whole
_STARTS = 1 << 14                # different first tokens of terms, at most, that are looked up in a text


def dictionary_hits(items: DataFrame, terms: DataFrame, id_col: str = "item_id", text: Column | None = None) -> DataFrame:
    """(id, term) for every term of a large vocabulary (``terms``: term, key = its tokens joined,
    size = their number) found in an item's text: the text's n-grams, for the sizes that the
    vocabulary has, are made in one pass, each kept once per item, and joined to the terms. A
    phrase matches over white space only, as its pattern would. The n-grams, many times the text,
    stay where they are made: the vocabulary goes to them, in pieces of ``_SENT_TERMS`` terms."""
    t = text if text is not None else scoring_text("title", "summary")
    counted = terms.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()     # a few numbers
    sizes = sorted(r["size"] for r in counted)
    starts = [r[0] for r in terms.select(F.get(term_tokens("key"), F.lit(0))).distinct().limit(_STARTS + 1).collect()]
    places = F.sequence(F.lit(1), F.size("tokens"))
    if len(starts) <= _STARTS:      # only where some term's first token is
        places = F.filter(places, lambda i: F.element_at("tokens", i).isin(starts))
    grams = F.flatten(F.transform(places, lambda i: F.array(*(
        F.when(i <= F.size("tokens") - (n - 1), F.array_join(F.slice("tokens", i, n), "")) for n in sizes))))
    keys = (items.select(F.col(id_col).alias("id"), term_tokens(t).alias("tokens")).where(F.size("tokens") > 0)
            .select("id", F.explode(F.array_distinct(grams)).alias("key")).where(F.col("key").isNotNull()))
    pieces = max(1, -(-sum(r["n"] for r in counted) // _SENT_TERMS))
    listed = terms.select("term", "key")
    found = [keys.join(F.broadcast(listed if pieces == 1 else listed.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == i)), "key")
             for i in range(pieces)]
    return reduce(DataFrame.unionAll, found).select(F.col("id").alias(id_col), "term")
