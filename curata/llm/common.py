"""Helpers shared by the operators of this subpackage.

* ``scratch`` / ``stage``: intermediates written as Parquet below the folder that
  ``spark.checkpoint.dir`` names, so a lost executor never loses them.
* ``scan_words`` / ``hash_words``: 64-bit hashes of the words of many texts at once, in numpy.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.session import ensure_checkpoint_dir, ship_package
from curata.sources.tables import table_path

GROUP_BYTES = 1 << 20          # texts hashed in one numpy pass
SCANNED_BYTES = 4 << 20        # texts whose hashes are held at a time
_SEED = 20240229
_U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; also sends the package to the workers."""
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more (frees the shared folder)."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _random_odd(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(_SEED + salt)) | _U64(1)


_BYTE = _random_odd(256, 1)
_POSITION = _random_odd(4096, 2)
#: white space as the contracts name it: space and U+0009 to U+000D
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _positions(n: int) -> np.ndarray:
    global _POSITION
    if n > len(_POSITION):
        _POSITION = _random_odd(max(n, 2 * len(_POSITION)), 2)
    return _POSITION


def _scan_buffer(buf: np.ndarray, classes: np.ndarray | None, breaks: np.ndarray | None,
                 prefixes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word starts, and for each word its hash, the breaks before it and its prefixes'
    hashes, of one byte buffer. ``classes`` gives each byte a class: 0 separates words,
    and a change of class also ends one."""
    kind = (~_SPACE[buf]).view(np.uint8) if classes is None else classes[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = kind[0] > 0
    edge[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0)
    starts = np.flatnonzero(edge)
    if not len(starts):
        return starts, [np.zeros(0, _U64)] + [starts] * (breaks is not None) + [np.zeros(0, _U64)] * len(prefixes)
    spans = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, spans)
    value = _BYTE[buf[starts[0]:]] * _positions(int(spans.max()))[place]
    value[kind[starts[0]:] == 0] = 0
    at = starts - starts[0]
    found = [mix(np.add.reduceat(value, at))]
    if breaks is not None:
        found.append(np.cumsum(breaks[buf])[starts])
    for n in prefixes:  # of a word of fewer bytes: the whole word, as another feature
        total = np.zeros(len(starts), _U64)
        for j in range(n):
            inside = spans > j
            total[inside] += value[at[inside] + j]
        found.append(mix(total + _U64(n)))
    return starts, found


def scan_words(texts: list[bytes], lower: bool = True, classes: np.ndarray | None = None,
               breaks: np.ndarray | None = None, prefixes: tuple[int, ...] = ()) -> list[list[np.ndarray]]:
    """For each text, arrays with an entry per word, in order: the word's 64-bit hash;
    with ``breaks`` (a flag per byte) the number of such bytes before it, counted from
    any start; for each of ``prefixes`` the hash of the word's first so many bytes.

    A hash is a random linear form of the word's bytes, mixed; equal words have equal
    hashes, and two different words collide with probability about 2^-62. Texts are
    scanned in groups of about a MiB, longer ones in pieces cut at white space."""
    out: list[list[np.ndarray]] = []
    group: list[bytes] = []
    held = 0

    def scanned(data: bytes):
        buf = np.frombuffer(data, np.uint8)
        return _scan_buffer(_LOWER[buf] if lower else buf, classes, breaks, prefixes)

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        starts, found = scanned(b"\n".join(group) + b"\n")
        at = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group]))[:-1]
        out.extend(list(x) for x in zip(*(np.split(f, at) for f in found)))
        group, held = [], 0

    for text in texts:
        if len(text) > 2 * GROUP_BYTES:
            flush()
            parts, before = [], 0
            while text:
                cut = len(text)
                if cut > GROUP_BYTES:
                    spaces = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, count=GROUP_BYTES)])
                    cut = int(spaces[-1]) + 1 if len(spaces) else _next_space(text, GROUP_BYTES)
                found = scanned(text[:cut])[1]
                if breaks is not None:
                    found[1] = found[1] + before
                    before += int(breaks[np.frombuffer(text, np.uint8, count=cut)].sum())
                parts.append(found)
                text = text[cut:]
            out.append([np.concatenate(x) for x in zip(*parts)])
            continue
        group.append(text)
        held += len(text)
        if held >= GROUP_BYTES:
            flush()
    flush()
    return out


def hash_words(texts: list[bytes], lower: bool = True, classes: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text the hashes of its words, in order (see ``scan_words``)."""
    return [found[0] for found in scan_words(texts, lower, classes)]


def _next_space(text: bytes, start: int) -> int:
    found = [p for p in (text.find(bytes([c]), start) for c in np.flatnonzero(_SPACE)) if p >= 0]
    return min(found) + 1 if found else len(text)


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words (one per start; fewer words: none)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U64)
    factor = _random_odd(n, 3)
    total = np.zeros(count, _U64)
    for j in range(n):
        total += words[j:j + count] * factor[j]
    return mix(total)


def batched_bytes(sizes, limit: int):
    """Slices of consecutive items whose sizes sum to about ``limit`` (one at least)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def text_slices(batches, limit: int = SCANNED_BYTES):
    """Arrow batches cut so that their texts (column ``text``, string) sum to about ``limit``
    bytes: what a task works out beside a batch does not grow with the rows of a batch."""
    for batch in batches:
        at = [c.lower() for c in batch.schema.names].index("text")
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for few in batched_bytes(sizes, limit):
            part = batch.slice(few.start, few.stop - few.start)
            yield part, [t or "" for t in part.column(at).to_pylist()]


def remainder(id_column: str, modulus: int):
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, bound: int) -> DataFrame:
    """(order, text, label): whole texts of about ``bound`` labelled ids at most, chosen by
    a hash of the id, for fitting a classifier. ``usable``: a condition on ``doc_id``, if any.
    An id counts once: with its larger label and its smallest text."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)))
    rows = rows if usable is None else rows.where(usable)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, bound / max(1, rows.count()))
    order = F.xxhash64("doc_id", F.lit("sample"))
    rows = rows.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # a row per chosen id, so about ``bound`` small rows
    return (texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id")
            .agg(F.min("text").alias("text"), F.first("label").alias("label"))
            .select(order.alias("order"), "text", "label"))
