"""Each operator against brute force on small tables that hold nulls, empty and long
texts, ties, repeated rows and clashing column names, and on empty tables."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF001
from curata.llm import bpe, forest, huffman, neighbours, packing, pagetext, quality, rules, toxicity, warc
from curata.llm.common import read, remainder, scratch
from curata.llm.tokens import vocabulary_path
from curata.session import ship_package

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 977} der, étude {i}" for i in range(9000))
TEXTS = [
    (5, "The cat sat. The cat sat!"), (1, None), (2, ""), (3, " \n\t "), (9, LONG), (7, "don't_stop ½ İstanbul ΣΑΣ é"),
    (8, "a b c d e f g h i j " * 5), (8, "a b c d e f g h i j " * 5), (6, "one"), (None, "no id at all"), (4, "x\x1cy z 日本語"),
]
SCHEMA = "doc_id long, text string, lang string, n int, score double, kept boolean, piece int, start long"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame([(i, t, "en", 1, 0.5, True, 3, 4) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


#: the library's own, as its file gives it
TOKENIZER = Tokenizer.from_file(WORDS)


def library_ids(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_huffman_files_give_back_all_ids(docs, none):
    got = [tuple(r) for r in huffman.encode_and_read(docs).collect()]
    want, start = [], 0
    for key, text in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.append(library_ids(text), 1).astype("<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert huffman.encode_and_read(none).count() == 0


def test_huffman_lengths_are_optimal_and_limited():
    counts = np.array([1 << i for i in range(12)] + [0])
    free, tight = huffman.code_lengths(counts, 18), huffman.code_lengths(counts, 5)
    assert free.max() == 11 and tight.max() == 5 and tight[-1] == 0
    assert sum(2.0 ** -int(x) for x in tight if x) <= 1
    rng = np.random.default_rng(0)
    for n, m in ((1, 3), (2, 700), (500, 5000)):
        ids = rng.integers(0, n, m).astype(np.uint32)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=n))
        payload, marks = huffman.pack_bits(ids, huffman.canonical_codes(lengths), lengths)
        assert (huffman.Decoder(lengths).decode(payload, marks, m) == ids).all()


def test_packing_places_every_piece_once(docs, none):
    rows = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for key, text in TEXTS:
        ids = np.append(library_ids(text), 0).astype("<u4")
        for k in range(0, len(ids), 2048):
            want[key, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0


def test_search_empties_bins():
    rng = np.random.default_rng(2)
    lengths = rng.integers(600, 1100, 3000)
    bins = packing.Bins(lengths, 2048)
    bins.best_fit()
    first, squares = len(bins.held), sum(f * f for f in bins.fill)
    bins.search()
    assert sum(1 for x in bins.held if x) < first and sum(f * f for f in bins.fill) > squares
    assert sorted(p for x in bins.held for p in x) == list(range(len(lengths))) and max(bins.fill) <= 2048


def brute_components(texts, size, percent):
    sets = {}
    for key, text in texts:
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_forest_matches_all_pairs(spark, docs, none):
    table = read(spark, SF001, "documents")
    texts = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    for size in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_duplicates(table, size).collect()}
        assert got == brute_components(texts, size, 80)
    small = forest.near_duplicates(docs, 2).collect()
    named = brute_components([x for x in TEXTS if x[0] is not None], 2, 80)
    assert len(small) == len(TEXTS)
    for r in small:
        assert (r.n_shingles, r.component_id) == (named[r.doc_id] if r.doc_id is not None else (3, None))
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert forest.near_duplicates(none, 2).count() == 0


def test_forest_holds_a_large_group_of_near_copies(spark, docs):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for k in range(400):
        words = list(base)
        for i in rng.integers(0, 120, 3):
            words[i] = f"new{k}x{i}"
        texts.append((k, " ".join(words)))
    got = forest.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 2).collect()
    want = brute_components(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_forest_links_a_hub_with_copies_edited_in_different_places(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(300)]
    texts = [(5000, " ".join(base))]
    for k in range(1000):
        words = list(base)
        for i in rng.choice(149, 15, replace=False):  # to the original 0.82, to each other under 0.8
            words[2 * i + 1] = f"new{k}x{i}"
        texts.append((k, " ".join(words)))
    got = forest.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 2, 80)
    assert {r.component_id for r in got} == {0}


def test_forest_splits_regions_of_unlinked_pages_from_one_template(spark, monkeypatch):
    template = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(2000):  # to each other 0.75; each of the last 20 is linked with the row before it
        own = [f"new{k}x{i}" for i in range(20)]
        texts.append((k, " ".join(template + own)))
        if k >= 1980:
            texts.append((k + 20, " ".join(template + own[:-2] + ["other", str(k)])))
    sizes = []
    cells = forest.open_cells

    def counted(dense, groups):
        rows = cells(dense, groups)
        sizes.append(rows.groupBy("region", "i", "j").count().agg({"count": "max"}).first()[0])
        sizes.append(rows.select("i", "j").distinct().count())
        return rows

    monkeypatch.setattr(forest, "open_cells", counted)
    keyed = [(i, text) for i, (_, text) in enumerate(texts)]
    got = forest.near_duplicates(spark.createDataFrame(keyed, "doc_id long, text string").repartition(5), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - (i >= 1980 and i % 2) for i, _ in keyed}
    assert sizes[1] > 6 and sizes[0] <= 2 * forest.BLOCK + 128


PAGES = [(4, "http://a/4", "<p>same</p>"), (9, None, "<p>same</p>"), (2, "http://a/2\r\nX: y", "<p>same</p>"), (1, "u", None),
         (3, "u", ""), (5, "u", "<p>ünlike"), (9, "u", "<p>same</p>"), (None, "u", "<p>same</p>"), (6, "u", "x" * 700_000)]


def test_warc_round_trip(spark, docs):
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in PAGES], "page_id long, url string, html string, digest string")
    path = scratch(spark, "test-warc")
    warc.write_bundles(pages, path)
    rows = warc.read_bundles(spark, path).collect()
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want, used = [], set()
    for i, _, h in PAGES:
        data = (h or "").encode()
        lead = i == best[h or ""] and (i, h) not in used
        used.add((i, h))
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if lead else "revisit",
                     None if lead else best[h or ""]))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    index = warc.read_index(spark, path)
    assert index.count() == len(PAGES)
    wanted = index.where("record_id like 'urn:page:5:%' or record_id like 'urn:page:6:%'").select("record_id")
    got = {r.record_id: bytes(r.record) for r in warc.fetch(spark, path, wanted).collect()}
    assert "<p>ünlike".encode() in got["urn:page:5:0"] and b"x" * 700_000 in got["urn:page:6:0"]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_page_text(spark, docs):
    html = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies on this long page, agree please.</div>
      <article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>&nbsp;text,<br>more  of\nit.<p>Second.
      <div class="ad">Buy now</div><p>Third &lt;here&gt;.</article>
      <section class=comments><p>What a long reader comment that says nothing of use to anybody at all.</section>
      <form><label>Mail</label></form><footer>&copy; me</footer></body>"""
    want = "Head & line\n\nFirst bold text, more of it.\n\nSecond.\n\nThird <here>."
    pages = spark.createDataFrame([(1, "u", html, 7), (2, None, None, 7), (None, "u", "", 7), (3, "u", "<article><p>cut <a hre", 7),
                                   (4, "u", "<article>" + "<p>Long enough text here.</p>" * 3000, 7)],
                                  "page_id long, url string, html string, n_chars int")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in pagetext.extract(pages).collect()}
    assert got[1] == ("u", want, len(want)) and got[2] == (None, "", 0) and got[None] == ("u", "", 0)
    assert got[3][1] == "cut" and got[4][1].count("Long enough") == 3000
    assert pagetext.extract(pages.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        costs = [tuple(map(float, rng.random(2) * 2)) for _ in range(n)]
        edges = [(i, j, float(rng.random() * 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def total(labels):
            return (sum(c[0] if x else c[1] for c, x in zip(costs, labels))
                    + sum(w for i, j, w in edges if labels[i] != labels[j]))

        best = min(total([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(total(pagetext.minimum_cut(costs, edges)) - best) < 1e-9


def test_byte_bpe_matches_the_library(docs, none):
    import tiktoken
    known = bpe.ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    want = []
    for key, text in TEXTS:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_and_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_rules_base_measures(docs, none):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                              for r in rules.judge(docs).collect())
    want = collections.Counter()
    for key, text in TEXTS:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
             len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)] += 1
    assert got == want
    assert rules.judge(none).count() == 0


def test_rules_reject_what_diverges(spark, docs):
    rng = np.random.default_rng(0)
    plain = [" ".join(rng.choice(["the", "of", "and", "house", "tree", "river", "to", "in", "walks"], 150)) for _ in range(40)]
    loud = " ".join(f"{w.upper()}!!%%" for w in rng.permutation([f"x{i}" for i in range(200)]))
    rows = [(i, t, "en") for i, t in enumerate(plain)] + [(99, loud, "en"), (100, "too short", None)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept or got[i].base_failed for i in range(40)) and not got[99].kept and not got[99].base_failed
    assert not got[100].kept and got[100].char_distance is None


def test_js_distance(spark, docs):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "p array<double>, q array<double>")
    got = [r[0] for r in row.select(rules.js_distance(F.col("p"), F.col("q"))).collect()]
    assert abs(got[0] - 0.5 ** 0.5) < 1e-12 and got[1] == 1.0


def test_neighbours_reach_the_recall(spark, docs):
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((900, 16)).astype(np.float32)
    rows[10:300] = rows[10]  # one vector that a third of the rows share
    table = [(i, [float(x) for x in r], 1) for i, r in enumerate(rows)]
    table += [(900, None, 1), (901, [0.0] * 16, 1), (920, [float("nan")] * 16, 1), (940, [None] * 16, 1), (903, [1.0], 1)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<float>, rank int").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.neighbours_of_twentieths(vectors).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    exact = rows.astype(np.float64) @ rows.astype(np.float64).T
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] != q for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and all(abs(exact[q, f[1]] - f[2]) < 1e-9 for f in found)
        scores = np.sort(np.delete(exact[q], q))[-20]
        hit += sum(f[2] >= scores - 1e-9 for f in found)
    assert hit >= 0.9 * 20 * len(got)
    few = neighbours.neighbours_of_twentieths(vectors.where("vec_id < 4")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == sorted([1, 2, 3], key=lambda i: (-exact[0, i], i))
    assert neighbours.neighbours_of_twentieths(vectors.limit(0)).count() == 0
    fine = np.random.default_rng(5).standard_normal((60, 8))  # doubles that float32 would round
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(fine)], "vec_id long, embedding array<double>")
    for r in neighbours.neighbours_of_twentieths(table).collect():
        assert abs(r.score - float(fine[r.query_id] @ fine[r.vec_id])) < 1e-12


def test_quality_and_toxicity_on_held_out_rows(spark, docs, none):
    rng = np.random.default_rng(6)
    vocabulary = [f"plain{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 40))
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            words[7] = str(rng.choice(["vilea", "vileb", "crud"]))
        if not good:
            words = [w + "!!" for w in words]
        texts.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]), 0.1))
        labels.append((i, good, toxic))
    table = spark.createDataFrame(texts, "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, 7)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for module, which, modulus, rest in ((quality, 0, 4, 2), (toxicity, 1, 5, 0)):
        rows = module.score_documents(table, marks).collect()
        assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.predicted == truth[r.doc_id][which] for r in held) >= 0.95 * len(held)
        odd = module.score_documents(docs, marks)
        assert odd.count() == len(TEXTS) and odd.where("score is null or predicted is null").count() == 0
        assert module.score_documents(none, marks).count() == 0
        assert module.score_documents(table, marks.limit(0)).count() == 600
    model = toxicity.train(table, marks, remainder("doc_id", 5) != 0)
    found = toxicity.offending_sentences(table.where("doc_id in (0, 1, 5)"), model, 0.3).collect()
    worst = {r.doc_id: r.worst_sentence for r in toxicity.score(table, model).where("doc_id in (0, 5)").collect()}
    assert worst == {0: 14, 5: 0}
    # document 0 ends each word with two sentence ends, so its eighth word is in sentence 14
    assert {(r.doc_id, r.sentence) for r in found} == {(0, 14), (5, 0)}


def test_vocabulary_is_a_parameter():
    assert vocabulary_path("word_bpe_49k.json") == WORDS


SENTENCE = "One two three four five six seven eight nine ten eleven."


@pytest.mark.parametrize("html, want", [
    (f"<div class='article-with-sidebar'><p>{SENTENCE}</p></div>", SENTENCE),
    (f"<article class='post search-results'><p>{SENTENCE}</p></article>", SENTENCE),
    (f"<div id=search-results-page><article><p>{SENTENCE}</p></article></div>", SENTENCE),
    (f"<div id=search-results-page><p>{SENTENCE}</p></div>", ""),
    (f"<div id=comments><article class=comment><p>{SENTENCE}</p></article></div>", ""),
    ("<article><p>One is <a href=x title=it's>link</a> and the rest goes on for long enough.</p><p>It's two of them.</p></article>",
     "One is link and the rest goes on for long enough.\n\nIt's two of them."),
    (f"<article><a title='a > b' href=\"c>d\">{SENTENCE}</a><p>{SENTENCE}</p><p title='>", f"{SENTENCE}\n\n{SENTENCE}"),
    ("<script a='1' b='2'" * 400, ""),
])
def test_page_names_and_quotes(html, want):
    assert pagetext.main_text(html) == want


def test_the_cut_decides_a_short_block_by_its_neighbours():
    long = " ".join(["word"] * 40)
    alone, between = f"<body><p>Yes.</p></body>", f"<body><p>{long}</p><p>Yes.</p><p>{long}</p></body>"
    own = [b.logit for b in pagetext.blocks_of(between)]
    assert own[0] > 0 > own[1] and own[2] > 0          # by its own cost the short block would go
    assert pagetext.main_text(alone) == "" and pagetext.main_text(between) == f"{long}\n\nYes.\n\n{long}"
