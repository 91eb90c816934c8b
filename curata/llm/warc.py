"""Operator 4: WARC records in seekable Zstandard bundles.

``write_bundles`` makes one WARC/1.1 record per page. Records are grouped into frames of
about ``FRAME_BYTES``, each compressed independently; a bundle is a run of frames and a
footer seek table (a skippable frame: sizes of each frame, their number, the seekable
magic), so any frame can be found and read without the others. An index maps each record
identifier to its bundle, frame, offset within the uncompressed frame, and length.

Pages with equal payloads (SHA-1) share one response record, that of the largest page id;
the others are revisit records without a payload that name it.

Files: ``bundles`` holds one bundle per row (Spark writes no bare binary files; the cell
``data`` is the .warc.zst file, byte for byte) and the index columns beside it, read
without the data when only the index is wanted.

Plan: digests of all pages; per digest the largest id, a partial aggregation; only digests
that occur twice or more are joined back, salted, so a payload that a third of all pages
share is spread; one shuffle of the pages by id to meet their verdicts.

Defined results: null html = empty payload; a null page id counts as the smallest; of
repeated rows with the winning id one is the response, the others are revisits to the same
id; a null url leaves out the target; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import scratch

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 16 * 1024 * 1024
SALTS = 16
_NO_ID = -(1 << 63)
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BUNDLES = ("bundle string, record_ids array<string>, frames array<int>, offsets array<long>, "
            "lengths array<long>, data binary")


def record_id(page_id: int, copy: int) -> str:
    return f"urn:page:{'' if page_id == _NO_ID else page_id}:{copy}"


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return int(page) if page else None


def make_record(page_id: int, copy: int, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                revisit: bool) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP header, which has the payload's length."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{record_id(page_id, copy)}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, 0)}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, content and end of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    begin, size = stop + 4, int(headers["Content-Length"])
    if data[begin + size:begin + size + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return headers, data[begin:begin + size], begin + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with (compressed, uncompressed) sizes."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frame_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    at, spans = 0, []
    for compressed, size in struct.iter_unpack("<II", data[len(data) - 9 - 8 * count:-9]):
        spans.append((at, compressed, size))
        at += compressed
    return spans


def read_frame(data: bytes, span: tuple[int, int, int]) -> bytes:
    import zstandard
    start, compressed, size = span
    return zstandard.ZstdDecompressor().decompress(data[start:start + compressed], max_output_size=size or 1)


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, name: str):
        import zstandard
        self.name, self.compressor = name, zstandard.ZstdCompressor(level=3)
        self.records, self.held = [], 0
        self.frames, self.sizes, self.size = [], [], 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, identifier: str, record: bytes) -> None:
        if self.records and self.held + len(record) > FRAME_BYTES:
            self._end_frame()
        self.index.append((identifier, len(self.frames), self.held, len(record)))
        self.records.append(record)
        self.held += len(record)
        self.size += len(record)

    def _end_frame(self) -> None:
        if self.records:
            packed = self.compressor.compress(b"".join(self.records))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.held))
            self.records, self.held = [], 0

    def row(self) -> pd.DataFrame:
        self._end_frame()
        ids, frames, offsets, lengths = (list(x) for x in zip(*self.index))
        return pd.DataFrame({"bundle": [self.name], "record_ids": [ids], "frames": [frames], "offsets": [offsets],
                             "lengths": [lengths], "data": [b"".join(self.frames) + seek_table(self.sizes)]})


def _with_verdicts(pages: DataFrame) -> DataFrame:
    """Each page with its digest, the response's id, and whether its payload repeats."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    keys = rows.select("page_id", "digest")
    shared = (keys.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    repeats = (keys.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
               .join(salted, ["digest", "salt"]).select("page_id", "digest", "response"))
    known = repeats.groupBy("page_id").agg(F.collect_list(F.struct("digest", "response")).alias("known"))
    # one shuffle of the payloads: the join keeps the partitions by page id
    met = rows.repartition("page_id").join(known, "page_id", "left")
    own = F.filter("known", lambda x: x["digest"] == F.col("digest"))
    return met.withColumn("response", F.get(own, F.lit(0))["response"]).drop("known")


def write_bundles(pages: DataFrame, path: str) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) below ``path``."""
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        writer, last, copy = BundleWriter(f"{task:06d}-{number:06d}"), None, 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                copy = copy + 1 if r.page_id == last else 0
                response = None if r.response is None else int(r.response)
                # the first of repeated rows of the winning page is the response
                first = not (copy and r.page_id == last and r.digest == last_digest)
                revisit = response is not None and (response != r.page_id or not first)
                last, last_digest = r.page_id, r.digest
                record = make_record(int(r.page_id), copy, r.url, r.html.encode(),
                                     base64.b32encode(r.digest).decode(), response, revisit)
                writer.add(record_id(int(r.page_id), copy), record)
                if writer.size >= BUNDLE_BYTES:
                    yield writer.row()
                    number += 1
                    writer = BundleWriter(f"{task:06d}-{number:06d}")
        if writer.index:
            yield writer.row()

    rows = _with_verdicts(pages).select("page_id", "url", "html", "digest", F.col("response").cast("long"))
    rows = rows.withColumn("response", F.col("response").cast("string"))  # no rounding of null-bearing longs
    rows = rows.sortWithinPartitions("page_id", "digest")
    rows.mapInPandas(run, _BUNDLES).write.option("compression", "uncompressed").parquet(f"{path}/bundles")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: its page, type, payload length and digest, and what it refers to.
    Response payloads are checked against their digests."""
    def run(batches):
        for batch in batches:
            for data in batch["data"]:
                out = []
                for span in frame_spans(data):
                    frame, at = read_frame(data, span), 0
                    while at < len(frame):
                        headers, content, at = parse_record(frame, at)
                        head, payload = content.split(b"\r\n\r\n", 1)
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload) != size or base64.b32encode(
                                hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                        refers = headers.get("WARC-Refers-To", "").strip("<>")
                        out.append((str(page_of(headers["WARC-Record-ID"].strip("<>")) or 0),
                                    page_of(headers["WARC-Record-ID"].strip("<>")) is None, size, digest, kind,
                                    str(page_of(refers)) if refers and page_of(refers) is not None else None))
                yield pd.DataFrame(out, columns=["page_id", "no_id", "payload_bytes", "payload_digest",
                                                 "record_type", "refers_to"])

    rows = spark.read.schema(_BUNDLES).parquet(f"{path}/bundles").select("data").mapInPandas(
        run, "page_id string, no_id boolean, payload_bytes long, payload_digest string, record_type string, "
             "refers_to string")
    return rows.select(F.when(~F.col("no_id"), F.col("page_id").cast("long")).alias("page_id"), "payload_bytes",
                       "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, bundle, frame, offset, length) of every record."""
    rows = spark.read.schema(_BUNDLES).parquet(f"{path}/bundles").drop("data")
    return rows.select("bundle", F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("r")).select(
        F.col("r.record_ids").alias("record_id"), "bundle", F.col("r.frames").alias("frame"),
        F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))


def fetch(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """(record_id, record) of the wanted records (column record_id); decompresses only the
    frames that hold one."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                spans, frames = frame_spans(r.data), {}
                for w in r.wanted:
                    if w["frame"] not in frames:
                        frames[w["frame"]] = read_frame(r.data, spans[w["frame"]])
                    out.append((w["record_id"], frames[w["frame"]][w["offset"]:w["offset"] + w["length"]]))
            yield pd.DataFrame(out, columns=["record_id", "record"])

    wanted = (read_index(spark, path).join(record_ids.select("record_id").distinct(), "record_id")
              .groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("wanted")))
    data = spark.read.schema(_BUNDLES).parquet(f"{path}/bundles").select("bundle", "data")
    return data.join(wanted, "bundle").select("data", "wanted").mapInPandas(run, "record_id string, record binary")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archive all pages and read the archives back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_bundles(pages, path)
    return read_bundles(spark, path)
