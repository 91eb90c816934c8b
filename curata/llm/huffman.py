"""Operator 1: token ids in files of canonical, length-limited Huffman codes.

``write_ids`` encodes a table of texts into one global sequence of ids, in ascending order
of the document id, and writes it as independent blocks; ``read_ids`` reads the files back.

Files, below one path:

* ``codebook``: (id, length, n). Canonical codes follow from the lengths: codes ascend by
  (length, id). Lengths come from the counts of all ids of the corpus (package-merge) and
  are at most ``MAX_LENGTH``, so one table of 2^MAX_LENGTH entries decodes any id.
* ``blocks``: one row per block (shard, block, start, doc_ids, lengths, checkpoints,
  payload). A block holds whole documents, about ``BLOCK_TOKENS`` ids (one longer document
  has a block of its own), and decodes without any other block. ``checkpoints`` gives the
  bit offset of every ``CHECKPOINT``-th id; decoding runs from all of them side by side.

Plan: one range shuffle of the texts by document id, tokenising in Arrow batches, a
per-task count of ids summed by Spark (at most one row per id of the vocabulary reaches the
driver), an encoding pass without a shuffle. Only per-shard totals (one number a partition)
pass through the driver to give the global starts.

Defined results: null text = empty text (only the end id); null document id sorts first;
repeated document ids stay separate rows, in order of their text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import drop_staged, scratch, stage, whole_text
from curata.llm.tokens import vocabulary_path, word_tokens

MAX_LENGTH = 18
BLOCK_TOKENS = 1 << 20
CHECKPOINT = 256

_RAW = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, ids binary"
_BLOCKS = ("shard int, block int, start long, doc_ids array<long>, lengths array<long>, "
           "checkpoints array<long>, payload binary")


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(leaves))
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - last
        last = n
        ids = np.flatnonzero(lengths == n)
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids`` (most significant bit first) and its checkpoints."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    slot, shift = at >> 6, (at & 63).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << (64 - size).astype(np.uint64)
    words = np.zeros(int(ends[-1] + 63) // 64 + 1, np.uint64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    words[slot[first]] = np.bitwise_or.reduceat(value >> shift, first)
    over = np.flatnonzero((at & 63) + size > 64)
    words[slot[over] + 1] |= value[over] << (np.uint64(64) - shift[over])
    return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::CHECKPOINT]


class Decoder:
    """Table-driven decoding: one lookup of ``width`` bits gives an id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(int(lengths.max(initial=0)), 1)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.size = np.ones(1 << self.width, np.uint8)
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        span = np.left_shift(1, self.width - lengths[ids].astype(np.int64))
        filled = int(span.sum())
        self.symbol[:filled] = np.repeat(ids, span)
        self.size[:filled] = np.repeat(lengths[ids], span)

    def decode(self, payload: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        if not count:
            return np.zeros(0, np.uint32)
        data = payload + bytes(16 + -len(payload) % 8)
        words = np.frombuffer(data, ">u8").astype(np.uint64)
        at = np.asarray(checkpoints, np.int64).copy()
        out = np.zeros((CHECKPOINT, len(at)), np.uint32)
        drop = np.uint64(64 - self.width)
        last = len(words) * 64 - 65
        for step in range(min(CHECKPOINT, count)):
            slot, shift = at >> 6, (at & 63).astype(np.uint64)
            window = (words[slot] << shift) | ((words[slot + 1] >> np.uint64(1)) >> (np.uint64(63) - shift))
            key = window >> drop
            out[step] = self.symbol[key]
            at += self.size[key]
            np.minimum(at, last, out=at)  # the last lane may run past the end
        return out.T.reshape(-1)[:count]


def _tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches):
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        encode, end = word_tokens(path).encode, np.array([end_id], "<u4").tobytes()
        ids, keys, sizes, held = [], [], [], 0

        def row():
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [start], "doc_ids": [keys],
                                 "lengths": [sizes], "ids": [b"".join(ids)]})

        for batch in batches:
            for key, missing, text in zip(batch["doc_id"], batch["no_id"], batch["text"]):
                got = encode(text) + end
                n = len(got) // 4
                if keys and held + n > BLOCK_TOKENS:
                    yield row()
                    start, block = start + held, block + 1
                    ids, keys, sizes, held = [], [], [], 0
                ids.append(got)
                keys.append(None if missing else int(key))
                sizes.append(n)
                held += n
        if keys:
            yield row()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
                       F.col("doc_id").isNull().alias("no_id"), whole_text().alias("text"))
    return (rows.repartitionByRange(F.desc("no_id"), "doc_id")
            .sortWithinPartitions(F.desc("no_id"), "doc_id", "text").mapInPandas(run, _RAW))


def _counts(raw: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                got = np.bincount(np.frombuffer(ids, "<u4"), minlength=len(total))
                got[:len(total)] += total
                total = got
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    rows = raw.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``; see the module's text."""
    spark = docs.sparkSession
    raw = stage(_tokenised(docs, vocabulary, end_id), "huffman-raw")
    counts = _counts(raw)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": used, "length": lengths[used].astype("int32"), "n": counts[used]}),
                          "id long, length int, n long").coalesce(1).write.parquet(f"{path}/codebook")
    sizes = raw.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = {r["shard"]: r["n"] for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    before, base = 0, {}
    for shard in sorted(totals):
        base[shard] = before
        before += totals[shard]
    shared = spark.sparkContext.broadcast((canonical_codes(lengths), lengths, base))

    def run(batches):
        codes, bits, base = shared.value
        for batch in batches:
            for r in batch.itertuples(index=False):
                payload, marks = pack_bits(np.frombuffer(r.ids, "<u4"), codes, bits)
                yield pd.DataFrame({"shard": [r.shard], "block": [r.block], "start": [base[r.shard] + r.start],
                                    "doc_ids": [r.doc_ids], "lengths": [r.lengths], "checkpoints": [marks],
                                    "payload": [payload]})

    raw.mapInPandas(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_staged(spark, raw)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, ids as little-endian uint32."""
    book = spark.read.parquet(f"{path}/codebook").select("id", "length").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["length"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(shared.value)
            for r in batch.itertuples(index=False):
                sizes = np.asarray(r.lengths, np.int64)
                ends = np.cumsum(sizes)
                ids = decoder.decode(r.payload, r.checkpoints, int(ends[-1])).astype("<u4")
                yield pd.DataFrame({
                    "doc_id": pd.array([None if x is None or x != x else int(x) for x in r.doc_ids], "Int64"),
                    "start": r.start + ends - sizes, "n_tokens": sizes,
                    "ids": [ids[e - n:e].tobytes() for e, n in zip(ends, sizes)]})

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def encode_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of all documents, read them back, and digest each document."""
    spark = docs.sparkSession
    path = scratch(spark, "huffman-ids")
    write_ids(docs, path, vocabulary or vocabulary_path("word_bpe_49k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
