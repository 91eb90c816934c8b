from curata.operators.similarity import find_related


def _docs(spark, rows):
    return spark.createDataFrame(rows, "item_id long, title string, summary string, url string")


def test_topical_prior_ranks_first(spark):
    cand = _docs(spark, [(1, "Acme releases vector database", "fast vector search engine", "u1")])
    priors = _docs(spark, [(2, "Vector database benchmark", "vector search engine speed", "u2"),
                           (3, "Cooking pasta tonight", "tomato sauce recipe", "u3")])
    rel = find_related(cand, priors, 3, 0.05).orderBy("rank").collect()
    assert [r.related_item_id for r in rel] == [2] and rel[0].similarity > 0


def test_threshold_and_empty_priors(spark):
    cand = _docs(spark, [(1, "Acme releases vector database", "fast vector search", "u1")])
    priors = _docs(spark, [(3, "Cooking pasta tonight", "tomato sauce recipe", "u3")])
    assert find_related(cand, priors, 3, 0.2).count() == 0
    assert find_related(cand, priors.limit(0), 3, 0.08).count() == 0


def test_all_pairs_equal_bruteforce(spark):
    import math
    from collections import Counter
    import re
    from curata.functions.text import STOP_WORDS
    rows = [(i, f"t{i % 7} alpha{i % 3} beta{i % 5}", f"gamma{i % 4} delta{i % 2} common word", "u")
            for i in range(40)]
    docs = _docs(spark, rows)
    got = {(r.item_id, r.related_item_id): r.similarity for r in find_related(docs, docs, 100, 0.08).collect()}
    toks = {i: Counter(t for t in re.findall(r"[a-z0-9]+", f"{a} {b}".lower())
                       if t not in STOP_WORDS and len(t) > 1) for i, a, b, _ in rows}
    df = Counter(t for c in toks.values() for t in c)
    n = len(toks)
    vec = {i: {t: c * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in cnt.items()} for i, cnt in toks.items()}
    exp = {}
    for a in vec:
        for b in vec:
            if a == b:
                continue
            dot = sum(vec[a][t] * vec[b].get(t, 0.0) for t in vec[a])
            sim = dot / (math.sqrt(sum(v * v for v in vec[a].values())) * math.sqrt(sum(v * v for v in vec[b].values())))
            if sim >= 0.08:
                exp[(a, b)] = round(sim, 4)
    assert got == exp


def test_no_copy_of_a_candidate_is_shuffled(spark, monkeypatch):
    """Several blocks of priors: candidates meet them in a cartesian product of packed rows, and
    the pairs are those of one block."""
    from curata.operators import similarity as S
    rows = [(i, f"t{i % 7} alpha{i % 3} beta{i % 5}", f"gamma{i % 4} delta{i % 2} rare{i // 2} common word", "u")
            for i in range(60)]
    docs, asked = _docs(spark, rows), _docs(spark, rows[:20] + [(99, "alpha1 beta2 unseen", "rare3 common", "u")])
    want = [sorted(map(tuple, S.find_related(c, docs, 3, 0.08).collect())) for c in (docs, asked)]
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 80)
    monkeypatch.setattr(S, "CHUNK_POSTINGS", 60)
    for dense in (0.03, 2.0):
        monkeypatch.setattr(S, "_DENSE", dense)      # 2.0: inverted lists only
        found = [S.find_related(c, docs, 3, 0.08) for c in (docs, asked)]
        assert [sorted(map(tuple, f.collect())) for f in found] == want
    plan = found[0]._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan


def test_related_pairs_are_stored_without_texts(spark):
    from conftest import SF001
    from curata.catalog import shared
    shared.forget()
    assert "related_summary" in shared.related_items(spark, SF001).columns
    path, schema = shared._WRITTEN[(spark.sparkContext.applicationId, SF001, "related-pairs")]
    assert schema.names == ["item_id", "related_item_id", "similarity", "rank"]


def test_entries_are_not_shuffled_as_rows(spark, monkeypatch):
    """Texts are dealt by id; the entries (document, term) stay in place and become few rows."""
    from curata.operators import similarity as S
    docs = _docs(spark, [(i, f"alpha{i % 3} beta{i}", "common word gamma", "u") for i in range(50)])
    tf = S.term_frequency(docs)
    plan = tf.groupBy("id").agg({"term": "count"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    monkeypatch.setattr(S, "CHUNK_POSTINGS", 40)
    pieces = S._pieces(tf).collect()
    assert sum(p.entries for p in pieces if p.ids) == tf.count() and sum(p.docs for p in pieces if p.ids) == 50
    assert 1 < len(pieces) < 40


def test_null_and_repeated_ids(spark, monkeypatch):
    """Rows of one id are one document; a null id counts as one, linked with nothing."""
    import math
    from curata.operators import similarity as S
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 12)
    monkeypatch.setattr(S, "CHUNK_POSTINGS", 5)
    docs = _docs(spark, [(1, "red fox", "jumps", "u"), (1, "red", "", "u"), (2, "red fox", "", "u"), (3, "blue sky", "", "u"),
                         (0, "blue", "", "u"), (None, "red whale", "", "u"), (None, "blue whale", "", "u")]).repartition(3)
    got = {r.item_id: r.links for r in S.link_counts(S.term_frequency(docs), 0.01).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 0: 1}
    none = _docs(spark, [(None, "red whale", "", "u")])
    assert S.link_counts(S.term_frequency(none), 0.01).count() == 0
    idf = lambda df: math.log(6 / (df + 1)) + 1          # 0, 1, 2, 3 and one for the null ids
    tf = [{"red": 2, "fox": 1, "jumps": 1}, {"red": 1, "fox": 1}]
    w = [{t: c * idf({"red": 3, "fox": 2, "jumps": 1}[t]) for t, c in x.items()} for x in tf]
    sim = sum(w[0][t] * w[1][t] for t in w[1]) / math.prod(math.sqrt(sum(v * v for v in x.values())) for x in w)
    pairs = S.cosine_pairs(S.term_frequency(docs), docs.select(docs.item_id.alias("id")).where("id = 2"), 0.01).collect()
    assert [(p.item_id, p.related_item_id) for p in pairs] == [(2, 1)] and abs(pairs[0].sim - sim) < 1e-9


def test_whole_related_texts_are_sent_once_to_a_part(spark, monkeypatch):
    """As joined row by row, for null, repeated and unrelated items and repeated priors, with many
    items of one prior in several parts; no row with whole related texts is shuffled."""
    from curata.operators.similarity import with_priors
    from curata.plans import generation as G
    ids = [None, None, 3, 3, *range(40)]
    items = _docs(spark, [(i, f"title {i}", f"text {i} é" * 3, f"u{n}") for n, i in enumerate(ids)]).repartition(4)
    pairs = spark.createDataFrame([(i, r, 0.5 - r / 100, k + 1) for i in range(35) for k, r in enumerate(
        [7, 3, 20 + i % 4][:1 + i % 3])], "item_id long, related_item_id long, similarity double, rank int")
    monkeypatch.setattr(G, "PART_ITEMS", 6)
    monkeypatch.setattr(G, "_HELD_CHARS", 60)
    got = G.with_related_texts(items, pairs, items)
    want = G.with_related(items, with_priors(pairs, items))
    rows = lambda df: sorted(map(repr, df.select("item_id", "title", "url", "summary", "related").collect()))
    assert rows(got) == rows(want)
    assert got.schema["related"].dataType.simpleString() == want.schema["related"].dataType.simpleString()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")     # the last step: nothing is shuffled after it


def test_texts_of_single_rows_stay_in_place(spark, monkeypatch):
    """Where no id repeats nothing is dealt by id, and the words of a document that several batches
    or pieces' ends meet are counted as ``term_frequency`` counts them."""
    from collections import Counter
    from curata.operators import similarity as S
    docs = _docs(spark, [(i, f"alpha{i % 3} beta{i} beta{i}", "common word gamma common " * (1 + i % 4), "u")
                         for i in range(40)] + [(None, "red whale red", "common", "u"), (77, "", "", "u")]).repartition(3)
    words = S._words(docs, "item_id")
    plan = words.mapInArrow(lambda b: b, "id long, term string, tf int")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1                  # the test's own
    tf = S.term_frequency(docs)
    monkeypatch.setattr(S, "CHUNK_POSTINGS", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pieces = S._pieces(words, adjacent=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = [p for p in pieces if p.ids]
    assert len(held) > 3 and sum(p.docs for p in held) == 41 and sum(p.entries for p in held) == tf.count()
    got, own = Counter(), Counter()
    for p in held:
        terms = {p2.first + i: (t, n) for p2 in pieces if p2.piece == p.piece and p2.terms
                 for i, (t, n) in enumerate(zip(p2.terms, p2.own))}
        own.update(dict(terms.values()))
        for i, c, n in zip(*(S._spread(x).tolist() for x in (p.ids, p.code, p.tf))):
            assert (i, terms[c][0]) not in got
            got[i, terms[c][0]] = n
    assert got == {(r.id, r.term): r.tf for r in tf.where("id is not null").collect()}
    assert own == {r.term: r["count"] for r in tf.groupBy("term").count().collect()}


def test_best_rows_do_not_grow_with_the_blocks(spark, monkeypatch):
    """A task keeps the k best over all blocks of priors that it meets."""
    from curata.operators import similarity as S
    docs = _docs(spark, [(i, f"t{i % 7} alpha{i % 3} beta{i % 5}", f"gamma{i % 4} delta{i % 2} rare{i // 2} common word", "u")
                         for i in range(60)]).repartition(8)
    want = sorted(map(tuple, S.related_pairs(docs, docs, 3, 0.01).collect()))
    links = sorted(map(tuple, S.link_counts(S.term_frequency(docs), 0.3).collect()))
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 80)
    monkeypatch.setattr(S, "CHUNK_POSTINGS", 60)
    monkeypatch.setattr(S, "_WAVES", 1)
    words = S._words(docs, "item_id")
    found = S._search(None, words, 0.01, 3, True)
    assert found.rdd.getNumPartitions() > 4             # a row of candidates in each
    assert found.groupBy("item_id").count().where("count > 3").count() == 0
    counted = S._search(None, words, 0.3, 0, True)
    assert sorted(map(tuple, counted.collect())) == links
    assert sorted(map(tuple, S.related_pairs(docs, docs, 3, 0.01).collect())) == want


def test_texts_of_irrelevant_items_are_not_written(spark):
    from conftest import SF001
    from curata.catalog import shared
    from curata.operators.relevance import apply_relevance
    from curata.scope import TEST_SCOPE
    from curata.sources.items import document_items
    shared.forget()
    got = shared.relevant_items(spark, SF001)
    path, schema = shared._WRITTEN[(spark.sparkContext.applicationId, SF001, "scored-items")]
    written = spark.read.schema(schema).parquet(path)
    assert written.where("not relevant").count() > 0
    assert written.where("not relevant and coalesce(content, title, url) is not null").count() == 0
    want = apply_relevance(document_items(spark, SF001), TEST_SCOPE).where("relevant").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_terms_travel_as_cells(spark, monkeypatch):
    """A cell a part of the terms and piece is shuffled, not a row a term; numbers and df are those of
    the terms, with the terms of a part in several cells."""
    from curata.operators import similarity as S
    docs = _docs(spark, [(i, f"alpha{i % 3} beta{i}", f"gamma{i % 5} common w{i // 2}", "u") for i in range(60)]).repartition(4)
    tf = S.term_frequency(docs)
    monkeypatch.setattr(S, "_TERMS", 3)
    pieces = S._pieces(S._words(docs, "item_id"), adjacent=True)
    placed, blocks = S._placed(pieces, 3)
    got = {r.term: (r.code, r.df) for r in S._numbered(pieces, placed, listed=True).collect()}
    want = {r.term: r["count"] for r in tf.groupBy("term").count().collect()}
    assert {t: df for t, (_, df) in got.items()} == want and len({c for c, _ in got.values()}) == len(want)
    rows = S._numbered(pieces, placed).collect()
    assert len(rows) == pieces.where("terms is not null").count() and max(len(S._spread(r.code)) for r in rows) == 3
    number = {r.piece: r.number for r in placed.collect()}
    cells = {(r.number, r.place): r for r in rows}
    for p in pieces.where("terms is not null").collect():
        cell = cells[number[p.piece], p.first]
        assert list(zip(S._spread(cell.code).tolist(), S._spread(cell.df).tolist())) == [got[t] for t in p.terms]
    import numpy as np
    for values in (np.array([5, 3, -1, 2 ** 40, 7]), np.array([9, 2, 2 ** 31 - 1, 0], np.int32), np.array([], np.int64)):
        for rising in (True, False):
            assert S._spread(S._squeeze(values, rising)).tolist() == values.tolist()


def test_related_topk_asks_for_every_item(spark, tmp_path):
    """Not only for those whose id is divisible by a hundred, in the code and in its SQL."""
    import duckdb

    import __spark_entry__ as driver
    from tools.oracle_check import digest
    texts = {7: "Vector thon of the search thing.", 13: "Vector tion thing search was.", 100: "Pasta tion of the sauce was.",
             201: "Pasta thon sauce thing.", 305: None}
    spark.createDataFrame([(i, t, "en", f"src{i}") for i, t in texts.items()], "doc_id long, text string, lang string, source string"
                          ).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(driver.oracle_sql()["related_topk"])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    got = driver.queries()["related_topk"](spark, str(tmp_path))
    assert {r[0] for r in rows} == {7, 13, 100, 201}
    assert digest(got.columns, [tuple(r) for r in got.collect()]) == digest(columns, rows)


def test_two_blocks_meet_once(spark, monkeypatch):
    """Where all documents ask all, a pair of blocks is multiplied once for both sides; the best and
    the links are those of a plain search, with copies of a document and cosines near the threshold."""
    import math
    import random
    from collections import Counter
    from curata.operators import similarity as S
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(3, 25))) for _ in range(50)]
    texts += [texts[3]] * 12 + [texts[7] + " extra"]
    docs = _docs(spark, [(3 * i + 1, t, "", "u") for i, t in enumerate(texts)]).repartition(6)
    tf = [Counter(t.split()) for t in texts]
    df = Counter(t for c in tf for t in c)
    vec = [{t: m * (math.log((len(tf) + 1) / (df[t] + 1)) + 1) for t, m in c.items()} for c in tf]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    sim = {(a, b): sum(x * vec[b].get(t, 0.0) for t, x in vec[a].items()) / norm[a] / norm[b]
           for a in range(len(tf)) for b in range(len(tf)) if a != b}
    edge = sorted(sim.values())[len(sim) // 2]          # some pair is just at the threshold
    for least in (0.2, edge - 1e-12, edge + 1e-12):
        best = [sorted((-round(sim[a, b], 10), b) for b in range(len(tf)) if b != a and sim[a, b] >= least)[:3] for a in range(len(tf))]
        want = sorted((3 * a + 1, 3 * b + 1, i + 1) for a, found in enumerate(best) for i, (_, b) in enumerate(found))
        links = sorted((3 * a + 1, sum(sim[a, b] >= least for b in range(len(tf)) if b != a)) for a in range(len(tf)))
        for size, dense in ((60, 0.05), (60, 2.0), (10 ** 6, 0.05))[:3 if least == 0.2 else 1]:
            monkeypatch.setattr(S, "BLOCK_POSTINGS", size)
            monkeypatch.setattr(S, "CHUNK_POSTINGS", size)
            monkeypatch.setattr(S, "_DENSE", dense)
            got = S.related_pairs(docs, docs, 3, least).select("item_id", "related_item_id", "rank")
            assert sorted(map(tuple, got.collect())) == want
            assert sorted(map(tuple, S.link_counts(S.term_frequency(docs), least).collect())) == links
    pieces = S._pieces(S._words(docs, "item_id"), adjacent=True)
    monkeypatch.setattr(S, "BLOCK_POSTINGS", 60)
    placed, blocks = S._placed(pieces, 1)
    packed = S._joined(pieces, placed, S._numbered(pieces, placed), blocks)
    plan = S._mutual(packed, len(tf), 0.2, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert blocks > 1 and "CartesianProduct (p_block" in plan


def test_words_are_cut_where_pieces_are_made(spark, monkeypatch):
    """Whole texts give the pieces that a row per word gives; no word is a row of the plan."""
    from curata.operators import similarity as S
    texts = ["The vector's DB-2 a b7 \u212aelvin \u0130stanbul c", None, "the of a", "x" * 50 + " x9 x9\nx9", "\u00e9t\u00e9 no_new nine"]
    docs = _docs(spark, [(None if i == 7 else i, texts[i % 5], f"s{i // 2} Vector", "u") for i in range(30)]).coalesce(2)
    monkeypatch.setattr(S, "CHUNK_POSTINGS", 20)
    monkeypatch.setattr(S, "_WORDS", 9)

    def entries(rows):
        pieces = S._pieces(rows, adjacent=True).collect()
        terms, out = {}, []
        for p in sorted((p for p in pieces if p.terms is not None), key=lambda p: (p.piece, p.first)):
            terms.setdefault(p.piece, []).extend(p.terms)
        for p in pieces:
            if p.ids is not None:
                ids, codes, tf = (S._spread(x).tolist() for x in (p.ids, p.code, p.tf))
                out += [(d, terms[p.piece][c], n) for d, c, n in zip(ids, codes, tf)]
        return sorted(out), sum(p.docs or 0 for p in pieces)
    assert entries(S._texts(docs, "item_id")) == entries(S._words(docs, "item_id"))
    assert "Generate" not in S._texts(docs, "item_id")._jdf.queryExecution().executedPlan().toString()
    seen = []
    monkeypatch.setattr(S, "_pieces", lambda tf, adjacent=False, make=S._pieces: seen.append(tf.columns) or make(tf, adjacent))
    S.related_pairs(docs.where("item_id is not null"), docs.where("item_id < 9"), 3, 0.08).collect()
    assert seen == [["id", "text"]]
