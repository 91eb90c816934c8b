"""Operator 11: alignment of two tokenizers' tokens by interval coalescing.

Both tokenizers cover the same bytes (one space, then the text), so tokens are byte
intervals. All tokens of both, sorted by start (``lexsort``), with the running maximum of
their ends (``maximum.accumulate``): a group begins where a start reaches the maximum of
the ends before it. Within groups each A token is linked to every B token that it overlaps.

1. Texts become token ids, packed in chunks that are written once (``chunks.py``).
2. A chunk sends each distinct linked pair of ids, with its number of links, to the part of
   the pair; the sums return to the chunk, and each part's highest sum per B id (at most
   one row per id of the vocabulary) is merged and broadcast: its bound is the vocabulary.
3. Chunks make the links again from the ids and add up counts per document.

A pair that a third of all links hold is one entry a chunk. Plain (Latin) texts take faster
ways to the same ids: A's vocabulary as merge ranks, and B word by word from a bounded memo
(no piece of B joins a word to what follows a space or line feed); others, and words whose
tokens lose bytes, go to the libraries whole.

Defined results: texts that are null, empty, or whose tokens do not give back the space and
the text have no tokens, zeros and the empty groups string; null ids stay null; repeated
rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.chunks import CHUNK_BYTES, bucketed, by_part, pack, part_count, unpack, with_answers
from curata.llm.common import batched_bytes, stage, whole_text
from curata.llm.tokens import _PLAIN, _byte_letters

MEMO_WORDS = 200_000
_ENCODED = 1 << 20               # characters whose words are looked up together
_ALIGNED = 1 << 18               # tokens of both kinds that are aligned together, unless one document has more
_MERGED = 1 << 20                # pairs of a part that are merged at a time
_PACKED = "keys array<string>, sizes_a binary, sizes_b binary, a binary, b binary, bytes long"
_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_U64 = np.uint64


class Tokenizers:
    """Ids of a text by both vocabularies, as arrays, or None where they lose bytes."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer
        self.whole_a = Tokenizer.from_file(byte_vocabulary)
        self.whole_a.encode_special_tokens = True
        back = {c: b for b, c in _byte_letters().items()}
        with open(byte_vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        entries = model["vocab"]
        self.bytes_a = [b""] * max(self.whole_a.get_vocab_size(), max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        self.whole_b = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        self.bytes_b = []
        for i in range(self.whole_b.get_piece_size()):
            piece = self.whole_b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.whole_b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.lengths_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.plain_a = self._ranked(model, public_tokenizers.PATTERN)
        self.words_b: dict[str, bytes] = {}
        self.split_b = re.compile(r" +[^ \n]*|[^ \n]+|\n").findall

    def _ranked(self, model: dict, pattern: str):
        """The same vocabulary for the faster of two libraries, if its merges rank as its ids."""
        import tiktoken
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][x + y] for x, y in pairs]
        if made != sorted(made):
            return None
        ranks = {self.bytes_a[i]: i for i in [*(i for i, t in enumerate(self.bytes_a) if len(t) == 1), *made]}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _pieces_b(self, texts: list[str]) -> list[bytes | None]:
        """Ids of plain texts; each distinct piece of text between spaces and line feeds that
        the memo does not know is encoded once. After a line feed no piece can join what came
        before it, so the first two ids, of " \\n", are cut off."""
        split = [self.split_b(" " + t) for t in texts]
        wanted = set().union(*split)
        if len(self.words_b) + len(wanted) > MEMO_WORDS:
            self.words_b.clear()
        new = [w for w in wanted if w not in self.words_b]
        for word, ids in zip(new, self.whole_b.encode(["\n" + w for w in new], num_threads=1)):
            if b"".join([self.bytes_b[i] for i in ids[2:]]) == word.encode():
                self.words_b[word] = array("H", ids[2:]).tobytes()
        known = self.words_b

        def joined(words: list[str]) -> bytes | None:
            try:
                return b"".join([known[w] for w in words])
            except KeyError:                        # a word whose pieces lose bytes
                return None
        return [joined(words) for words in split]

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        a = self.whole_a.encode(" " + text, add_special_tokens=False).ids
        b = self.whole_b.encode(text, num_threads=1)
        want = b" " + text.encode()
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        return array("H", a).tobytes(), array("H", b).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Both tokenizers' ids of each text as uint16 bytes."""
        found: list[tuple[bytes, bytes] | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self.plain_a is not None and _PLAIN.fullmatch(t)]
        for i, b in zip(plain, self._pieces_b([texts[i] for i in plain]) if plain else []):
            if b is not None:
                found[i] = array("H", self.plain_a.encode_ordinary(" " + texts[i])).tobytes(), b
        for i, text in enumerate(texts):
            if text and found[i] is None:
                found[i] = self._whole(text)
        return found


@lru_cache(maxsize=2)
def tokenizers(byte_vocabulary: str, piece_vocabulary: str) -> Tokenizers:
    """Both tokenizers and their memos, once per Python worker."""
    return Tokenizers(byte_vocabulary, piece_vocabulary)


@lru_cache(maxsize=2)
def token_lengths(byte_vocabulary: str, piece_vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token of both, all that is needed once texts are ids: a worker that goes
    on from encoding to aligning lets the tokenizers and memos go."""
    known = tokenizers(byte_vocabulary, piece_vocabulary)
    tokenizers.cache_clear()
    return known.lengths_a, known.lengths_b


class Aligned:
    """Groups and links of a chunk of documents."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b])
        starts_a, starts_b = ends_a - lengths_a[a], ends_b - lengths_b[b]
        starts = np.concatenate([starts_a, starts_b])
        kind = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
        order = np.lexsort((kind, starts))
        reach = np.maximum.accumulate(np.concatenate([ends_a, ends_b])[order])
        opens = np.ones(len(order), bool)
        opens[1:] = starts[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int32)
        group[order] = np.cumsum(opens) - 1
        self.group_a, self.group_b = group[:len(a)], group[len(a):]
        low = np.searchsorted(ends_b, starts_a, "right")
        links = np.searchsorted(starts_b, ends_a, "left") - low
        count = int(links.sum())
        linked = np.repeat(low - (np.cumsum(links) - links), links) + np.arange(count)
        self.links = links.astype(np.int32)
        #: of every link, in order of its A token: its B id and A id
        self.pairs = (b[linked].astype(_U64) << _U64(32)) | np.repeat(a, links).astype(_U64)

    def group_texts(self, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        groups = int(self.group_a[-1]) + 1 if len(self.a) else 0
        in_a, in_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        # a group's A tokens come first, then its B tokens; both kinds are in order already
        at_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[np.cumsum(in_a) - 1] = 1             # 0: comma, 1: bar, 2: semicolon
        mark_b[np.cumsum(in_b) - 1] = 2
        entry = np.empty(len(self.a) + len(self.b), np.int64)
        entry[at_a], entry[at_b] = self.a.astype(np.int64) * 3 + mark_a, self.b.astype(np.int64) * 3 + mark_b
        shown = list(map(_shown().__getitem__, entry.tolist()))
        ends = np.cumsum(sizes_a + sizes_b).tolist()
        return ["".join(shown[lo:hi])[:-1] for lo, hi in zip([0, *ends], ends)]


@lru_cache(maxsize=1)
def _shown() -> list[str]:
    return [f"{i}{mark}" for i in range(1 << 16) for mark in ",|;"]


def _aligned(row, lengths: tuple[np.ndarray, np.ndarray]):
    """(documents, Aligned, sizes_a, sizes_b) of the documents of a chunk, some at a time:
    documents share no group, and the working arrays are many times as large as the ids."""
    import zstandard
    a, b = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint16) for x in (row.a, row.b))
    sizes_a, sizes_b = unpack(row.sizes_a, np.int64), unpack(row.sizes_b, np.int64)
    ends_a, ends_b = np.append(0, np.cumsum(sizes_a)), np.append(0, np.cumsum(sizes_b))
    for some in batched_bytes((sizes_a + sizes_b).tolist(), _ALIGNED):
        lo, hi = some.start, some.stop
        yield (some, Aligned(a[ends_a[lo]:ends_a[hi]], b[ends_b[lo]:ends_b[hi]], *lengths), sizes_a[some], sizes_b[some])


def _pairs(parts) -> np.ndarray:
    return np.concatenate([np.zeros(0, _U64), *(found.pairs for _, found, _, _ in parts)])


def _chunked(docs: DataFrame, vocabularies: tuple[str, str], chunk_bytes: int) -> DataFrame:
    def run(batches):
        import zstandard
        known = tokenizers(*vocabularies)
        keys, found, held = [], [], 0

        def row():
            squeeze = zstandard.ZstdCompressor(level=1).compress
            sizes = [np.array([len(x[k]) // 2 for x in found], np.int64) for k in (0, 1)]
            return pd.DataFrame({"keys": [keys], "sizes_a": [pack(sizes[0])], "sizes_b": [pack(sizes[1])],
                                 "a": [squeeze(b"".join(x for x, _ in found))],
                                 "b": [squeeze(b"".join(y for _, y in found))], "bytes": [held]})

        for batch in batches:
            all_keys, texts = batch["key"].tolist(), batch["text"].tolist()
            for some in batched_bytes([len(t) for t in texts], _ENCODED):
                for key, text, ids in zip(all_keys[some], texts[some], known.encode(texts[some])):
                    if keys and held + len(text) > chunk_bytes:
                        yield row()
                        keys, found, held = [], [], 0
                    keys.append(key)
                    found.append(ids or (b"", b""))
                    held += len(text)
        if keys:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("key"), whole_text().alias("text"))
    return bucketed(rows.mapInPandas(run, _PACKED), "align-chunks")


def _counted(chunks: DataFrame, vocabularies: tuple[str, str], parts: int) -> DataFrame:
    """(chunk, part, answer, best): the links of each distinct pair of a chunk, in the order
    of the pairs; and, with no chunk, the highest sum per B id of a part."""
    def ask(batches):
        lengths = token_lengths(*vocabularies)
        for batch in batches:
            for row in batch.itertuples(index=False):
                key, number = np.unique(_pairs(_aligned(row, lengths)), return_counts=True)
                out = [(int(row.chunk), part, pack(key[own]), pack(number[own].astype(np.uint32)))
                       for part, own in by_part(key, parts)]
                if out:
                    yield pd.DataFrame(out, columns=["chunk", "part", "key", "number"])

    def distinct(rows) -> np.ndarray:
        """The pairs of a part, ascending; merged as they come, as chunks share most of them."""
        pair, held, size = np.zeros(0, _U64), [], 0
        for r in rows:
            held.append(unpack(r.key, _U64))
            size += len(held[-1])
            if size > max(_MERGED, len(pair)):
                pair, held, size = np.unique(np.concatenate([pair, *held])), [], 0
        return np.unique(np.concatenate([pair, *held]))

    def answer(batches):
        rows = [r for batch in batches for r in batch.itertuples(index=False)]
        if not rows:
            return
        pair = distinct(rows)
        total = np.zeros(len(pair), np.int64)
        for r in rows:
            total[np.searchsorted(pair, unpack(r.key, _U64))] += unpack(r.number, np.uint32)  # a chunk's pairs are distinct
        for some in range(0, len(rows), 256):
            found = [(str(r.chunk), r.part, pack(total[np.searchsorted(pair, unpack(r.key, _U64))]), None)
                     for r in rows[some:some + 256]]
            yield pd.DataFrame(found, columns=["chunk", "part", "answer", "best"])
        second = (pair >> _U64(32)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
        best = [{"b": int(b), "n": int(n)} for b, n in zip(second[heads], np.maximum.reduceat(total, heads))]
        yield pd.DataFrame({"chunk": [None], "part": [-1], "answer": [None], "best": [best]})

    asked = chunks.select("chunk", "sizes_a", "sizes_b", "a", "b").mapInPandas(
        ask, "chunk long, part int, key binary, number binary")
    got = asked.repartition(parts, "part").mapInPandas(
        answer, "chunk string, part int, answer binary, best array<struct<b:int,n:long>>")
    return stage(got.withColumn("chunk", F.col("chunk").cast("long")), "align-answers")


def align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, chunk_bytes: int = CHUNK_BYTES,
          texts: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row
    of ``docs`` (doc_id, text); with ``texts`` also the groups themselves."""
    vocabularies = (byte_vocabulary, piece_vocabulary)
    chunks = _chunked(docs, vocabularies, chunk_bytes)
    parts = part_count(chunks)
    counted = _counted(chunks, vocabularies, parts)
    highest = (counted.where(F.col("part") < 0).select(F.explode("best").alias("x"))
               .groupBy("x.b").agg(F.max("x.n").alias("n")).toPandas())  # a row per id of B's vocabulary
    best = np.zeros(1 << 16, np.int64)
    best[highest["b"].to_numpy(np.int64)] = highest["n"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(best)
    columns = ["key", *_FIGURES, "groups_sha256", *(["groups"] if texts else [])]

    def counts(pairs, answers) -> np.ndarray:
        """The count of every link of a chunk, in order."""
        held = {int(x["part"]): x["answer"] for x in answers} if answers is not None else {}
        place, seen = pd.factorize(pairs)                          # hashed; only the distinct pairs are sorted
        order = np.argsort(seen)
        key = seen[order]
        total = np.zeros(len(key), np.int64)
        for part, own in by_part(key, parts):
            total[own] = unpack(held[part], np.int64)
        by_pair = np.empty(len(key), np.int64)
        by_pair[order] = total
        return by_pair[place]

    def figures(keys, found, sizes_a, sizes_b, count) -> pd.DataFrame:
        is_best = count == shared.value[(found.pairs >> _U64(32)).astype(np.int64)]
        ends_a = np.cumsum(sizes_a)
        before = np.append(0, np.cumsum(found.links))              # links before each A token
        per = lambda sums: np.diff(np.append(0, sums[before[ends_a]]))
        links = per(np.arange(len(count) + 1))
        n_best = per(np.append(0, np.cumsum(is_best)))
        sums = per(np.append(0, np.cumsum(count)))
        group = np.append(found.group_a, found.group_a[-1:] + 1)
        groups = np.diff(np.append(0, group[ends_a])) if len(found.a) else np.zeros(len(sizes_a), np.int64)
        shown = found.group_texts(sizes_a, sizes_b)
        out = pd.DataFrame({
            "key": keys, "n_a": sizes_a, "n_b": sizes_b, "n_groups": groups, "n_links": links,
            "n_best": n_best, "count_sum": sums,
            "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]})
        return (out.assign(groups=shown) if texts else out)[columns]

    def finish(batches):
        lengths = token_lengths(*vocabularies)
        for batch in batches:
            for row in batch.itertuples(index=False):
                aligned, keys, at = list(_aligned(row, lengths)), list(row.keys), 0
                count = counts(_pairs(aligned), row.answers)
                for some, found, sizes_a, sizes_b in aligned:
                    yield figures(keys[some], found, sizes_a, sizes_b, count[at:at + len(found.pairs)])
                    at += len(found.pairs)

    answers = counted.where(F.col("part") >= 0).select("chunk", "part", "answer")
    schema = "key string, " + ", ".join(f"{c} long" for c in _FIGURES) + ", groups_sha256 string"
    done = with_answers(chunks, answers).mapInPandas(finish, schema + (", groups string" if texts else ""))
    return done.select(F.col("key").cast("long").alias("doc_id"), *columns[1:])
