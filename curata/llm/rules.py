"""Operator 7: quality rules with distribution divergence, in DataFrame functions only.

Base rules: a document needs ``MIN_WORDS`` words, and at most 30 % of its words may lie in
8-word windows that occur twice or more in it.

Divergence: two histograms of each document are compared to its language's reference by the
Jensen-Shannon distance (the root of the divergence, base 2, from 0 to 1): character classes
(white space, capitals, digits, punctuation, signs, bytes of UTF-8 beyond one a character,
the rest) and common words of the language. References are the mean histograms over all
documents of the language that are long enough; a language without a word list uses the
words of all lists. A document fails when either distance is over its limit. Guards: the
histograms need ``MIN_CHARS`` characters and ``MIN_HISTOGRAM_WORDS`` words; shorter texts
are judged by the base rules alone.

Plan: one row-local pass over the texts, whose measures and small histograms are staged; one
partial aggregation to a row per language; a join back. Repeated windows are found inside
the row by hashes of the windows, doubled from words to pairs, fours and eights, and sorted
with their positions only in documents with fewer distinct hashes than windows.

Defined results: a null text has no words; a null language shares the reference of the
other null ones; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import stage, whole_text

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
MIN_CHARS = 400
MIN_HISTOGRAM_WORDS = 80
MAX_BROADCAST_LANGUAGES = 10_000
MAX_CHAR_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.285

#: fixed values: frequent function words by language code
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
_EVERY = sorted({w for words in COMMON_WORDS.values() for w in words})
_WORD = r"[^\x20\x09-\x0D]"
_COUNTED = {"capitals": "[A-Z]", "digits": "[0-9]", "punctuation": "[.,;:!?'\"()-]", "n_symbols": "[#*$%&|<>]"}
_HISTOGRAM_CHARS = 7


def _matches(pattern: str) -> Column:
    """How many characters of the text match (splitting costs by match, not by character)."""
    return F.size(F.split("text", pattern, -1)) - 1


def _doubled(hashes: str, step: int) -> Column:
    """Hashes of runs of ``2 * step`` words from those of runs of ``step`` words."""
    count = F.size(hashes) - step
    after = F.slice(hashes, step + 1, F.greatest(count, F.lit(0)))
    return F.zip_with(F.slice(hashes, 1, F.greatest(count, F.lit(0))), after, lambda x, y: F.xxhash64(x, y))


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The base measures and both histograms (shares that sum to 1; null where a guard
    holds) of every document; with ``carry``, also the document itself as the struct ``row``."""
    row = [F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    carried = ["row"] if carry else []
    spaced = F.regexp_replace("text", r"[\x09-\x0D]+", " ")
    rows = rows.withColumn("words", F.array_remove(F.split(spaced, " ", -1), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD))
    rows = rows.select(
        *carried, "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[_matches(pattern).cast("long").alias(name) for name, pattern in _COUNTED.items()],
        F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"),
        lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    rows = rows.withColumn("h2", _doubled("h1", 1)).withColumn("h4", _doubled("h2", 2))
    rows = rows.withColumn("hashes", _doubled("h4", 4))
    rows = rows.withColumn("pairs", F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.sort_array(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def repeated(p, k):
        return (F.coalesce(F.get("pairs", k - 1)["h"] == p["h"], F.lit(False))
                | F.coalesce(F.get("pairs", k + 1)["h"] == p["h"], F.lit(False)))

    rows = rows.withColumn("starts", F.sort_array(F.filter(
        F.transform("pairs", lambda p, k: F.when(repeated(p, k), p["i"])), lambda x: x.isNotNull())))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"),
                                                s.alias("last")), lambda a: a["n"])
    listed = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        listed = F.when(F.col("lang") == code, F.array(*map(F.lit, words))).otherwise(listed)
    listed = F.transform(F.coalesce(listed, F.array(*map(F.lit, _EVERY))), lambda w: F.xxhash64(w))
    common = F.filter("h1", lambda h: h.isin([F.xxhash64(F.lit(w)) for w in _EVERY]))
    rows = rows.withColumn("common", common).withColumn("listed", listed)
    rows = rows.withColumn("tally", F.transform("listed", lambda l: F.size(F.filter("common", lambda w: w == l))))
    counts = [F.col("chars") - F.col("word_chars"), *map(F.col, _COUNTED), F.col("bytes") - F.col("chars")]
    counts.append(F.col("bytes") - sum(counts[1:], counts[0]))
    hits = F.aggregate("tally", F.lit(0), lambda a, x: a + x)
    words = F.concat(F.transform("tally", lambda x: x / F.col("n_words")),
                     F.array((F.col("n_words") - hits) / F.col("n_words")))
    long_enough = (F.col("chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_HISTOGRAM_WORDS)
    return rows.select(
        *carried, "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(long_enough, F.array(*[c / F.col("bytes") for c in counts])).alias("char_share"),
        F.when(long_enough, words).alias("word_share"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    def term(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def pair(x, y):
        m = (x + y) / 2
        return (term(x, m) + term(y, m)) / 2

    total = F.aggregate(F.zip_with(p, q, pair), F.lit(0.0), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))


def _references(rows: DataFrame) -> DataFrame:
    """The mean histograms of each language over all its documents that pass the guards."""
    def means(name, size):
        return F.array(*[F.avg(F.get(name, F.lit(i))) for i in range(size)])

    words = max(len(_EVERY), *map(len, COMMON_WORDS.values())) + 1
    return rows.groupBy("lang").agg(
        means("char_share", _HISTOGRAM_CHARS).alias("char_reference"),
        F.filter(means("word_share", words), lambda x: x.isNotNull()).alias("word_reference"))


def _judged(measured: DataFrame, max_char: float, max_word: float) -> DataFrame:
    """``measured`` with both distances, base_failed and kept."""
    references = stage(_references(measured).withColumnRenamed("lang", "lang_"), "references")
    if references.count() <= MAX_BROADCAST_LANGUAGES:  # else Spark joins on the language
        references = F.broadcast(references)  # the documents, skewed by language, stay in place
    rows = measured.join(references, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    rows = (rows.withColumn("char_distance", js_distance(F.col("char_share"), F.col("char_reference")))
            .withColumn("word_distance", js_distance(F.col("word_share"), F.col("word_reference")))
            .withColumn("base_failed", failed))
    diverges = (F.coalesce(F.col("char_distance") > max_char, F.lit(False))
                | F.coalesce(F.col("word_distance") > max_word, F.lit(False)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~diverges)


def judge(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Base measures, distances and verdict of every document (doc_id, text, lang)."""
    return _judged(stage(measure(docs), "rules"), max_char, max_word).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance")


def passing(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that are kept. Each is staged with its measures, so the verdict is
    taken on the row itself, whatever its id, and texts are not joined back."""
    return _judged(stage(measure(docs, carry=True), "rules"), max_char, max_word).where("kept").select("row.*")
