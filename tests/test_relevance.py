from pyspark.sql import functions as F

from curata.functions.keywords import keyword_hits
from curata.functions.text import scoring_text
from curata.operators.relevance import apply_relevance, dictionary_hits, vocabulary
from curata.scope import Scope, Weights

SCOPE = Scope(name="Test AI", strong=("large language model", "framework", "api", "model"),
              normal=("ai", "tool"), signals=("launches", "introduces", "releases", "now available"),
              exclude=("opinion", "podcast", "top 10"), weights=Weights(3, 1, 2, 4, 1, 4))


def _items(spark, rows):
    return spark.createDataFrame(rows, "title string, summary string, source_weight double")


def test_announcement_is_relevant(spark):
    r = apply_relevance(_items(spark, [("Acme launches new model API", "A framework for AI tools", 2.0)]),
                        SCOPE).first()
    assert r.relevant and r.relevance_score >= 4 and r.signal_hits == ["launches"]
    assert r.status == "relevant"
    assert r.relevance_reasons[0] == "strong: framework, api, model"


def test_commentary_is_irrelevant(spark):
    r = apply_relevance(_items(spark, [("Opinion: top 10 AI podcast picks", "", 0.5)]), SCOPE).first()
    assert not r.relevant and r.exclude_hits == ["opinion", "podcast", "top 10"]


def test_only_normal_terms_dropped(spark):
    r = apply_relevance(_items(spark, [("AI tool roundup", "ai tool", 3.0)]), SCOPE).first()
    assert not r.relevant and "no in-scope signal (dropped)" in r.relevance_reasons


def test_word_boundary(spark):
    r = apply_relevance(_items(spark, [("The therapist", "rapid growth", 0.0)]), SCOPE).first()
    assert r.strong_hits == []


def test_phrase_crosses_title_and_summary(spark):
    r = apply_relevance(_items(spark, [("A large language", "model appears", 0.0)]), SCOPE).first()
    assert r.strong_hits == ["large language model", "model"]


def test_non_word_ending_keyword_needs_word_after(spark):
    s = Scope(name="x", strong=("c++",))
    r = apply_relevance(_items(spark, [("c++ now", "", 0.0), ("c++x", "", 0.0)]), s).collect()
    assert [x.strong_hits for x in r] == [[], ["c++"]]


def test_retarget_same_plan(spark):
    s2 = Scope(name="Podcasts", strong=("podcast",), signals=("picks",), weights=Weights(min_score=1))
    r = apply_relevance(_items(spark, [("Opinion: top 10 AI podcast picks", "", 0.5)]), s2).first()
    assert r.relevant and r.strong_hits == ["podcast"]


def test_words_and_dictionary_equal_the_patterns(spark):
    import re
    texts = ["Open  weights\nopen-weight, c++ we're hiring", "the-of the", "of\tthe top 10!", "", None, "ÉTÉ été_ l'été",
             "open - weight openweight", "top 100", "x" * 3000 + " of  the"]
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "item_id long, title string, summary string")
    terms = ["open weights", "open-weight", "we're hiring", "of the", "the", "top 10", "été", "weight", "l'été"]
    lowered = [(t or "").lower() + "\n" for t in texts]
    want = [[k for k in terms if re.search(r"\b" + r"\s+".join(map(re.escape, k.split())) + r"\b", t)] for t in lowered]
    hits = docs.select("item_id", keyword_hits(scoring_text("title", "summary"), terms).alias("hits"))
    assert [r.hits for r in hits.orderBy("item_id").collect()] == want
    got = {i: set() for i in range(len(texts))}
    for r in dictionary_hits(docs, vocabulary(spark, terms)).collect():
        assert r.term not in got[r.item_id]
        got[r.item_id].add(r.term)
    assert [got[i] for i in range(len(texts))] == [set(w) for w in want]


def test_ten_thousand_terms(spark):
    import random
    rng = random.Random(3)
    letters = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    terms = sorted({" ".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(20_000)})
    texts = [" ".join(rng.choice(letters) + rng.choice(["", "", "", ","]) for _ in range(300)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "item_id long, title string, summary string")
    got = {(r.item_id, r.term) for r in dictionary_hits(docs, vocabulary(spark, terms)).collect()}
    grams = [{" ".join(run[i:i + n]) for run in (r.split() for r in t.replace(",", " ,\n").split(","))
              for n in (1, 2, 3) for i in range(len(run) - n + 1)} for t in texts]
    assert len(terms) > 10_000 and got == {(i, k) for i, g in enumerate(grams) for k in terms if k in g}


def test_no_gram_is_shuffled(spark, monkeypatch):
    """The vocabulary goes to the n-grams, whole or in pieces, with the same hits."""
    from curata.operators import relevance as R
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(["open  weights of the", "the top 10", None, "weights"])],
                                 "item_id long, title string, summary string")
    terms = vocabulary(spark, ["open weights", "of the", "the", "top 10", "weights"])
    want = [(0, "of the"), (0, "open weights"), (0, "the"), (0, "weights"), (1, "the"), (1, "top 10"), (3, "weights")]
    for most in (1 << 18, 2):
        monkeypatch.setattr(R, "_SENT_TERMS", most)
        hits = dictionary_hits(docs, terms)
        assert sorted(map(tuple, hits.collect())) == want
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
