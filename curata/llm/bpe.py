"""Operator 8: byte-level BPE by a global shuffle of distinct words.

Encoding, in four steps:

1. A task reads whole texts, splits them into pre-tokens, and keeps the positions: a chunk
   of documents (about ``CHUNK_CHARS``) becomes its list of distinct words and, for every
   pre-token in order, its word's number in that list.
2. The distinct words of all chunks are exploded into parts by a hash of the word and
   shuffled by it. Where equal words meet, each distinct word is merged once; the part's ids
   go back to its chunk in the order of its words. Parts follow the bytes of text, so the
   distinct words that one part holds do not grow with the data.
3. The parts of a chunk are gathered: its dictionary, bounded by the chunk.
4. Chunks join their dictionaries by chunk number and put the ids in place of the numbers,
   position by position. Chunks are written in buckets of that number, so that the
   positions, by far the larger side, are not shuffled.

What moves is an entry per (chunk, distinct word), packed a part to a row, not one per
pre-token: a word of a third of all text is one entry a chunk. Decoding looks the ids up in
the table of token bytes (bounded by the vocabulary) and joins the bytes.

Defined results: null text = empty text = no ids; null document ids stay null; repeated
rows are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.chunks import PART_BYTES, bucketed, pack, unpack
from curata.llm.common import whole_text

CHUNK_CHARS = 3 << 20
_CHUNKS = ("keys array<string>, sizes array<long>, numbers binary, part_of binary, "
           "parts array<struct<part:int,lengths:binary,words:binary>>")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _merger(path: str):
    import public_tokenizers
    import tiktoken
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return own.encode_ordinary


class _Numbers(dict):
    """word -> its number, in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class _Merged(dict):
    """word's bytes -> its ids; each word is merged once. A pre-token stays one match of the
    pattern when it stands alone."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        got = self[word] = np.array(self.encode(word.decode()), "<u4").tobytes()
        return got


def _pieces(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class TokenBytes:
    """The table of token bytes, for joining many at once."""

    def __init__(self, vocabulary: str):
        table = ranks(vocabulary)
        known = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            known[i] = token
        self.lengths = np.array([len(t) for t in known], np.int64)
        self.flat = np.frombuffer(b"".join(known), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.flat[at].tobytes()


def _chunked(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    def run(batches):
        import zstandard
        split, squeeze = regex.compile(pattern).findall, zstandard.ZstdCompressor().compress
        numbers, keys, sizes, found, held = _Numbers(), [], [], [], 0

        def row():
            words = [w.encode() for w in numbers]
            part_of = np.array([zlib.crc32(w) % parts for w in words], "<u4")
            order = np.argsort(part_of, kind="stable")
            packed = []
            for own in np.split(order, np.flatnonzero(np.diff(part_of[order])) + 1):
                if len(own):
                    mine = [words[i] for i in own.tolist()]
                    packed.append({"part": int(part_of[own[0]]), "words": squeeze(b"".join(mine)),
                                   "lengths": pack(np.array([len(w) for w in mine], "<u4"), 3)})
            return pd.DataFrame({"keys": [keys], "sizes": [sizes], "numbers": [pack(np.concatenate(found), 3)],
                                 "part_of": [pack(part_of, 3)], "parts": [packed]})

        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                if keys and held + len(text) > CHUNK_CHARS:
                    full = row()
                    numbers, keys, sizes, found, held = _Numbers(), [], [], [], 0
                    yield full
                    del full
                own = np.array([numbers[w] for w in split(text)], "<u4")
                keys.append(key)
                sizes.append(len(own))
                found.append(own)
                held += len(text)
        if keys:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("key"), whole_text().alias("text"))
    return bucketed(rows.mapInPandas(run, _CHUNKS), "bpe-chunks")


def encode(docs: DataFrame, vocabulary: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text), ids as little-endian uint32;
    with ``decoded`` also the bytes that the ids stand for, made by the same worker."""
    size = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    chunks = _chunked(docs, pattern, parts)

    def merge(batches):
        import zstandard
        merged, expand = _Merged(_merger(vocabulary)), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for lengths, words in zip(batch["lengths"], batch["words"]):
                ids = [merged[w] for w in _pieces(expand(words), unpack(lengths, "<u4"))]
                sizes = np.array([len(x) // 4 for x in ids], "<u4")
                out.append((pack(sizes, 3), pack(np.frombuffer(b"".join(ids), "<u4"), 3)))
            yield pd.DataFrame({"chunk": batch["chunk"], "part": batch["part"], "sizes": [x for x, _ in out],
                                "ids": [y for _, y in out]})

    words = chunks.select("chunk", F.explode("parts").alias("p")).select("chunk", "p.part", "p.lengths", "p.words")
    merged = words.repartition(parts, "part").mapInPandas(merge, "chunk long, part int, sizes binary, ids binary")
    dictionaries = merged.groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct("part", F.col("sizes").alias("n"), "ids"))).alias("dictionary"))

    def place(batches):
        known = TokenBytes(vocabulary) if decoded else None
        for batch in batches:
            for r in batch.itertuples(index=False):
                order = np.argsort(unpack(r.part_of, "<u4"), kind="stable")
                entries = r.dictionary if r.dictionary is not None else []
                by_part = [unpack(e["n"], "<u4") for e in entries]
                ids = np.concatenate([unpack(e["ids"], "<u4") for e in entries] or [np.zeros(0, "<u4")])
                sizes_by_part = np.concatenate(by_part or [np.zeros(0, "<u4")]).astype(np.int64)
                lengths, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                lengths[order] = sizes_by_part
                starts[order] = np.cumsum(sizes_by_part) - sizes_by_part
                numbers = unpack(r.numbers, "<u4")
                ends = np.cumsum(np.asarray(r.sizes, np.int64))
                for lo in range(0, len(ends), 256):  # a few documents at a time
                    hi = min(lo + 256, len(ends))
                    first = int(ends[lo - 1]) if lo else 0
                    own = numbers[first:int(ends[hi - 1])]
                    size = lengths[own]
                    after = np.cumsum(size)
                    at = np.repeat(starts[own] - (after - size), size) + np.arange(int(size.sum()))
                    flat = ids[at]
                    bounds = np.append(0, after)[np.append(first, ends[lo:hi]) - first]
                    own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                    out = {"key": list(r.keys[lo:hi]), "ids": [x.tobytes() for x in own]}
                    yield pd.DataFrame(out | ({"bytes": [known.join(x) for x in own]} if decoded else {}))

    joined = chunks.select("chunk", "keys", "sizes", "numbers", "part_of").join(dictionaries, "chunk", "left")
    got = joined.select("keys", "sizes", "numbers", "part_of", "dictionary").mapInPandas(
        place, "key string, ids binary" + (", bytes binary" if decoded else ""))
    return got.select(F.col("key").cast("long").alias("doc_id"), *got.columns[1:])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, bytes) of every row of ``encoded`` (doc_id, ids)."""
    def run(batches):
        known = TokenBytes(vocabulary)
        for batch in batches:
            yield batch.assign(bytes=[known.join(np.frombuffer(ids, "<u4")) for ids in batch["ids"]])

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return rows.mapInPandas(run, "doc_id string, ids binary, bytes binary").select(
        F.col("doc_id").cast("long").alias("doc_id"), "ids", "bytes")


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return encode(docs, vocabulary, pattern, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
