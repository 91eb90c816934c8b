"""Operators 11, 12 and 13 against plain brute-force versions on small tables that hold
nulls, empty and long texts, ties, repeated rows, clashing column names and empty tables."""

import collections
import hashlib
import heapq
import json
import random
import re
import types
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from conftest import SF001
from curata.llm import alignment, chunks, suffixes, turns
from curata.llm.common import read
from curata.session import ship_package

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ["a  b\n\n c", "<|endoftext|> x <s>", "▁x", "日本語 text ½ ﬁ", "é" * 500, "a\tb\r\nc   ", "don't  stop",
         "x\x1cy\x85z　w", "\x00", " lead", "'s 's", "</s><unk>", "İstanbul ß", " ", "", None]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, rows):
    """The rows as documents, with more columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, 1, b"x", "en", 2) for i, t in rows],
                                 "doc_id long, text string, chunk int, key binary, part string, answers int").repartition(5)


def same_rows(got, want):
    return collections.Counter(map(tuple, got)) == collections.Counter(want)


# --- operator 11

def aligned_by_hand(rows):
    a_model = Tokenizer.from_file(BYTES)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    with open(BYTES, encoding="utf-8") as f:
        a_bytes = {i: bytes(back[c] for c in w) for w, i in json.load(f)["model"]["vocab"].items() if set(w) <= set(back)}
    b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i)
               else b_model.id_to_piece(i).replace("▁", " ").encode() for i in range(b_model.get_piece_size())]

    def intervals(ids, names):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(names[i]), i))
            at += len(names[i])
        return out

    found, count = [], collections.Counter()
    for key, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        want = b" " + (text or "").encode()
        if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            found.append((key, [], [], [], []))
            continue
        ia, ib, groups, start = intervals(a, a_bytes), intervals(b, b_bytes), [], 0
        for cut in sorted({x[1] for x in ia} & {x[1] for x in ib}):
            groups.append([[x for x in side if start <= x[0] and x[1] <= cut] for side in (ia, ib)])
            start = cut
        links = [(x[2], y[2]) for xs, ys in groups for x in xs for y in ys if x[0] < y[1] and y[0] < x[1]]
        count.update(links)
        found.append((key, a, b, groups, links))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for key, a, b, groups, links in found:
        shown = ";".join("|".join(",".join(str(x[2]) for x in side) for side in g) for g in groups)
        yield (key, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
               sum(count[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "")


def test_alignment_equals_groups_and_links_made_by_hand(spark):
    texts = [r.text for r in read(spark, SF001, "documents").orderBy("doc_id").limit(60).collect()]
    texts = [t[:3000] for t in texts] + EXTRA
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "other text"), (0, texts[0])]
    docs = table(spark, rows)
    got = alignment.align(docs, BYTES, PIECES, 20_000).collect()
    assert same_rows(got, aligned_by_hand(rows))
    assert alignment.align(docs.limit(0), BYTES, PIECES).count() == 0
    shown = alignment.align(docs.where("doc_id = 0"), BYTES, PIECES, texts=True).collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in shown)


def test_word_memos_give_the_libraries_ids(spark):
    known = alignment.tokenizers(BYTES, PIECES)
    assert known.plain_a is not None
    texts = [r.text for r in read(spark, SF001, "documents").collect()]
    for text, got in zip(texts, known.encode(texts)):
        assert got and np.frombuffer(got[0], np.uint16).tolist() == known.whole_a.encode(
            " " + text, add_special_tokens=False).ids
        assert np.frombuffer(got[1], np.uint16).tolist() == known.whole_b.encode(text)


def test_no_piece_joins_a_word_to_a_following_space():
    known = alignment.tokenizers(BYTES, PIECES)
    pieces = [known.whole_b.id_to_piece(i) for i in range(known.whole_b.get_piece_size())]
    assert all("▁" not in p.lstrip("▁") and (len(p) == 1 or "\n" not in p) for p in pieces)


def test_a_chunk_is_aligned_some_documents_at_a_time(monkeypatch):
    known = alignment.tokenizers(BYTES, PIECES)
    texts = ["some longer text, with numbers 123 and more. " * n for n in (1, 9, 2, 40, 1, 3)] + ["", "ends"]
    ids = [x or (b"", b"") for x in known.encode(texts)]
    sizes = [np.array([len(x[k]) // 2 for x in ids], np.int64) for k in (0, 1)]
    squeeze = zstandard.ZstdCompressor().compress
    row = types.SimpleNamespace(sizes_a=chunks.pack(sizes[0]), sizes_b=chunks.pack(sizes[1]),
                                a=squeeze(b"".join(x for x, _ in ids)), b=squeeze(b"".join(y for _, y in ids)))
    lengths = alignment.token_lengths(BYTES, PIECES)
    assert alignment.tokenizers.cache_info().currsize == 0      # the memos are not held while ids are aligned
    (whole,) = alignment._aligned(row, lengths)
    monkeypatch.setattr(alignment, "_ALIGNED", 100)
    parts = list(alignment._aligned(row, lengths))
    assert all(len(x.a) + len(x.b) <= 100 or some.stop - some.start == 1 for some, x, _, _ in parts) and len(parts) > 3
    assert (alignment._pairs(parts) == whole[1].pairs).all()
    assert sum((x.group_texts(p, q) for _, x, p, q in parts), []) == whole[1].group_texts(whole[2], whole[3])


# --- operator 12

def least_edits(rows):
    """Best-first search over (cost, audit): every edit sequence, the least one first."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i > len(rows):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows):
            if last in ("", "a"):
                heapq.heappush(heap, (cost, audit, i + 1, last, out))
        else:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if fault != "gone":
                more = 5 if fault == "cut" else 0
                for edit, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (last, name[:1]) in follow:
                        heapq.heappush(heap, (cost + price + more, audit + edit, i + 1, follow[last, name[:1]],
                                              out + ((name, text),)))
        for name in ("user", "assistant"):
            if (last, name[0]) in follow:
                heapq.heappush(heap, (cost + 5, audit + "I", i, follow[last, name[0]], out + ((name, ""),)))


def repaired_by_hand(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = conversations.setdefault(conv, [])
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own.extend([(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1))
    for conv, own in conversations.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(
            f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()[:16]))
        seen, faults = set(), []
        for _, role, text in own:
            last = text.strip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not last else "again" if (role, text) in seen else "cut" if last not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in own if t is not None]
        cost, audit, left = least_edits([(r, x, "gone" if f in ("blank", "again") else f)
                                         for (_, r, x), f in zip(own, faults)])
        yield (conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"),
               faults.count("again"), faults.count("cut"),
               sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:])), cost, audit,
               hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest())


def made_conversations(seed):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(300)]:
        for turn in range(40 if conv and conv % 60 == 0 else rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < .3 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and rng.random() < .4 else role
            role = rng.choice([None, "tool", "", "uther", "admin", "System", "s"]) if rng.random() < .06 else role
            text = rng.choice(["Hello there.", "What? ", "ok", "Yes!\n", " ", "", "é ende.\t", None, f"m{rng.random()}.",
                               f"q{rng.random()}?", f"x{rng.random()}", "long " * 500 + "."])
            number = None if rng.random() < .04 else turn + 3 * (rng.random() < .05)
            rows.extend([(conv, number, role, text)] * (2 if rng.random() < .05 else 1))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_repair_equals_a_search_over_all_edits(spark, seed):
    rows = made_conversations(seed)
    table_ = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, "
                                   "text string, cost int, audit string, no_conv boolean").repartition(5)
    damaged = turns.damage(table_)
    assert same_rows(turns.repaired_digests(damaged).collect(), repaired_by_hand(rows))
    assert turns.repaired_digests(turns.damage(table_.limit(0))).count() == 0
    whole = collections.defaultdict(list)
    for r in sorted(turns.repair(damaged).collect(), key=lambda r: r.place):
        whole[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in turns.repaired_digests(damaged).collect()}
    assert all(hashlib.sha256("\n".join(whole[c]).encode()).hexdigest() == d for c, d in digests.items())


def test_a_long_conversation_is_walked_block_by_block():
    rng = random.Random(5)
    rows = bytes(rng.choice([0, 4, 8, 12]) + rng.choice([0, 0, 0, 1, 2]) for _ in range(900))
    names, faults = {0: "tool", 4: "system", 8: "user", 12: "assistant"}, {0: "", 1: "cut", 2: "gone"}
    assert turns.cheapest_edits(rows) == least_edits([(names[r & 12], "t", faults[r & 3]) for r in rows])[:2]
    assert turns.cheapest_edits(b"") == (0, "")


# --- operator 13

def kept_by_hand(rows):
    last, first = suffixes._LAST, {}
    data = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, text in data:
        for p in range(len(text) - 99):
            first[text[p:p + 100]] = min(first.get(text[p:p + 100], (last, last)), (i, p))
    for (key, _), (i, text) in zip(rows, data):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 99):
            if first[text[p:p + 100]] < (i, p):
                gone[p:p + 100] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~gone]) if text else b""
        yield key, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def repeated_texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bases, shared, rows = [prose(120) for _ in range(6)], prose(40), []
    for i in range(60):
        own = rng.choice(bases).split(" ")
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        text = " ".join(own)
        if rng.random() < .4:
            text = prose(10) + shared + prose(10) + text[rng.randint(0, 200):]
        rows.append((i * 3, text))
    return rows + [(1000, None), (1001, ""), (1002, "a" * 5000), (1003, "ab" * 900), (None, bases[0]), (None, bases[1]),
                   (7, bases[2]), (7, bases[2]), (7, shared * 3), (1004, "x" * 99), (1005, "x" * 100), (1006, "x" * 101)]


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 3])
def test_repeats_equal_a_search_over_all_strings(spark, crowded):
    rows = repeated_texts(crowded)
    docs = table(spark, rows)
    assert same_rows(suffixes.digests(docs, crowded, 20_000).collect(), kept_by_hand(rows))
    assert suffixes.digests(docs.limit(0)).count() == 0


def test_the_suffix_sort_orders_windows_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    buf = np.tile(rng.integers(97, 99, 400).astype(np.uint8), 3)
    at = rng.permutation(len(buf) - suffixes.LENGTH)
    segment = np.sort(rng.integers(0, 5, len(at)))
    text = [buf[p:p + suffixes.LENGTH].tobytes() for p in at]
    want = [(s, t) for s, t in sorted(zip(segment.tolist(), text))]
    order, same = suffixes.sorted_windows(suffixes.Extensions(buf), at, segment)
    assert [(segment[i], text[i]) for i in order] == want
    assert same.tolist() == [i > 0 and want[i] == want[i - 1] for i in range(len(want))]
    # hashes that hold all long strings for equal: the bytes still decide
    monkeypatch.setattr(suffixes.Extensions, "common",
                        lambda self, x, y: np.full(len(x), suffixes.LENGTH, np.int64))
    order, same = suffixes.sorted_windows(suffixes.Extensions(buf), at, segment)
    assert [(segment[i], text[i]) for i in order] == want
    assert same.tolist() == [i > 0 and want[i] == want[i - 1] for i in range(len(want))]


def test_anchors_do_not_depend_on_what_stands_around():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    around = np.concatenate([rng.integers(97, 100, 777).astype(np.uint8), text, rng.integers(97, 100, 50).astype(np.uint8)])
    def windows(buf, shift):
        at, first, last, runs = suffixes.anchors(buf, np.array([len(buf)]))
        return {(p - shift, int(a) - shift) for a, f, l in zip(at, first, last) for p in range(f, l + 1)}
    assert windows(text, 0) <= windows(around, 777)
