"""Chunks of documents, kept in place while small questions about them travel.

A chunk table is written once, in buckets of ``chunk``; a step sends each chunk's distinct
keys to parts chosen by a hash of the key, and the answers of a part return by chunk number.
Joining them back reads the chunk table bucket by bucket, so its rows are never shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import mix, scratch

CHUNK_BYTES = 2 << 20           # bytes of text a chunk holds, unless one document has more
PART_BYTES = 32 << 20           # bytes of text per part of the questions


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """An array, its first bytes together, then its second ones, and so on, compressed."""
    import zstandard
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=level).compress(flat.T.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).reshape(-1)


def by_part(key: np.ndarray, parts: int):
    """(part, entries) for each part that has some, entries in ascending order."""
    part = (mix(key) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(key) else []
    for own in np.split(order, edges[1:]) if len(key) else []:
        yield int(part[own[0]]), own


def bucketed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number ``chunk``, written in buckets of it and read back. The catalog
    entry is dropped at once; the files stay in the shared folder."""
    spark = rows.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (rows.withColumn("chunk", F.monotonically_increasing_id())
     .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
     .option("path", scratch(spark, name)).option("compression", "uncompressed")
     .format("parquet").saveAsTable(table))
    written = spark.table(table)
    written.schema  # resolved, with its buckets, before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return written


def with_answers(chunks: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Chunks with all their rows of ``answers`` (chunk, ...) as an array ``answers``."""
    if answers is None:
        return chunks
    columns = [c for c in answers.columns if c != "chunk"]
    own = answers.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias("answers"))
    return chunks.join(own.hint("shuffle_hash"), "chunk", "left")


def part_count(chunks: DataFrame, bytes_column: str = "bytes") -> int:
    """Parts of the questions: they follow the bytes of text."""
    size = chunks.agg(F.sum(bytes_column)).first()[0] or 0
    return max(1, -(-size // PART_BYTES), chunks.sparkSession.sparkContext.defaultParallelism)
