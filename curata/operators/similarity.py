"""Related priors: TF-IDF cosine search with threshold and top-k.

Plan (one job for all candidates, instead of re-tokenising the archive per candidate):

  tokens -> tf(id, term, tf)                     A4, explode, counted in place (texts by id if ids repeat)
  pieces: many documents' entries in arrays      written once, with their distinct terms
  df(term), N, idf = ln((N+1)/(df+1)) + 1        A5, over the pieces' distinct terms
  packed rows: many documents' terms, tf, df     A6, pieces and their terms' numbers by block
  packed candidates x packed priors              J6, cartesian product of packed rows
  dot(a, b) / (|a| |b|) >= t, top-k per task     A7, F7, T1, a task meets many blocks of priors
                                                 (once for both sides where all documents ask all)
  top-k over the tasks, title / url / summary    T1, J7, late join on id

Every candidate meets every prior that shares a term with it. Joining postings row by row
made 652 million rows of the 5,079 relevant items at sf0.1, and prefix bounds do not help:
with each candidate's final third-best similarity (median 0.12) as the bound, 72 % of the
postings remain. So postings never become rows, and no copy of a candidate is shuffled: both
sides are packed once, one row of arrays per block, and a task reads one packed row of each
side from its checkpoint. An entry (document, term) is never shuffled as a row either: of the
entries only the distinct terms of a piece travel, and texts move only where ids repeat. A task
keeps the k best of a candidate over all blocks of priors (``BLOCK_POSTINGS``) it meets, and the
number of tasks a candidate is in does not grow with the priors, so what is written is linear in
the input: at most k rows, or one count, per candidate and such task.
Terms that many priors of a block hold are multiplied as a matrix, the others by inverted
lists. The work of a queue of given size is linear in the archive.

A candidate that is not among the priors counts as one more document, for itself only:
N + 1, and df + 1 for the terms it holds. The prior's norm changes only at shared terms, so
the same pass yields the correction.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.text import STOP_WORDS, doc_text, tokens
from curata.session import materialize, ship_package, stored

BLOCK_POSTINGS = 2_000_000      # (document, term) entries of priors that one packed row holds
CHUNK_POSTINGS = 1_000_000      # the same for a piece, and for candidates that are not the priors
_WORDS = 1 << 18                # words of texts that are counted at a time
_TERMS = 1 << 16                # terms of a piece that one row holds
_DENSE = 0.05                   # share of a block's priors from which a term goes to the matrix
_MATRIX = 1 << 22               # numbers in a matrix of priors' terms, or of similarities
_ENTRIES = ("id", "place", "tf")     # of a packed row, by entry; and by place, its distinct terms:
_TERMS_OF = ("code", "df")
_RISING = ("id", "place", "code")    # mostly, so that their steps are smaller than they are
_WAVES = 4                      # tasks for each core, at least, that a search is dealt to


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def term_frequency(docs: DataFrame, id_col: str = "item_id",
                   text: F.Column | None = None) -> DataFrame:
    """(id, term, tf). Documents without tokens produce no rows (they can never
    be related)."""
    t = text if text is not None else doc_text("title", "summary")
    # dealt by id before the texts are cut, so that the entries (three times the texts) stay in place
    return (docs.select(F.col(id_col).alias("id"), t.alias("text")).repartition("id")
            .select("id", F.explode(tokens("text")).alias("term"))
            .groupBy("id", "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf")))


def inverse_document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df, idf) with N = number of documents having at least one token."""
    n = _documents(tf).withColumnRenamed("n", "n_docs")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("df"))
    return (df.crossJoin(F.broadcast(n))   # one row
            .withColumn("idf", _idf(F.col("n_docs"), F.col("df")))
            .select("term", "df", "idf", "n_docs"))


def _documents(tf: DataFrame) -> DataFrame:
    """One row: the number of documents. Each id is counted at its least term, so nothing
    but one number per id moves."""
    return tf.groupBy("id").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n"))


_PIECES = ("piece long, part int, first int, terms array<string>, own array<int>, ids binary, code binary, tf binary, "
           "entries long, docs long")


def _parts(df: DataFrame) -> int:
    """The parts that terms are dealt to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _words(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf 1): a row per word, the words of a document after each other, nothing shuffled.
    For documents whose id is in one row; ``term_frequency`` brings rows of one id together."""
    return (docs.select(F.col(id_col).alias("id"), doc_text("title", "summary").alias("text"))
            .select("id", F.explode(tokens("text")).alias("term"), F.lit(1).alias("tf")))


_TOKEN = re.compile(rb"[a-z0-9]{2,}")      # as ``tokens`` cuts a lowered text, but for the stop words


def _texts(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, text): a row per document, for documents whose id is in one row; the words are cut where
    the pieces are made, so that none becomes a row."""
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.lower(doc_text("title", "summary")).cast("binary").alias("text"))


def _pieces(tf: DataFrame, adjacent: bool = False) -> DataFrame:
    """The entries of whole documents (``CHUNK_POSTINGS`` or a few more) as rows of compressed
    arrays, their terms by place in the piece's own list of terms; and that list, by ``part`` (a hash
    of the term) and term, with the number of documents of the piece that hold each term (``own``),
    in rows of one part and at most ``_TERMS``. A null id is one
    document that counts, but has no entries. Nothing is shuffled if ``tf`` is dealt by id, or if
    the rows of a document are ``adjacent``; these may hold a term more than once. ``tf`` may also be
    whole texts (``_texts``)."""
    texts = "text" in tf.columns
    if texts:
        rows = tf.select("id", "text")
    elif adjacent:
        rows = tf.select(F.col("id").cast("long").alias("id"), "term", F.col("tf").cast("int").alias("tf"))
    else:
        whole = tf.groupBy("id").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("e"))
        rows = whole.select(F.col("id").cast("long").alias("id"), F.explode("e").alias("e")).select("id", "e.term", "e.tf")
    limit, parts, names = CHUNK_POSTINGS, _parts(tf), [f.split()[0] for f in _PIECES.split(", ")]

    def counted(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        """A row per document and term, for rows whose documents follow each other."""
        known, ids = pc.is_valid(batch["id"]), pc.fill_null(batch["id"], 0)
        known, ids = known.to_numpy(zero_copy_only=False), ids.to_numpy()
        head = np.append(True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))
        at, wide = np.flatnonzero(head), len(batch["term"].dictionary)
        key = (np.cumsum(head) - 1) * wide + batch["term"].indices.to_numpy()
        key, place = np.unique(key, return_inverse=True)
        doc = at[key // wide]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[doc], mask=~known[doc]),
             pa.DictionaryArray.from_arrays(pa.array((key % wide).astype(np.int32)), batch["term"].dictionary),
             pa.array(np.bincount(place, batch["tf"].to_numpy(), len(key)).astype(np.int32))], names=["id", "term", "tf"])

    def piece(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = counted(pa.Table.from_batches(held).unify_dictionaries().combine_chunks().to_batches()[0])
        used, code = np.unique(entries["term"].indices.to_numpy(), return_inverse=True)
        terms = entries["term"].dictionary.take(pa.array(used))
        part = np.array([crc32(t.encode()) % parts for t in terms.to_pylist()], np.int32)
        order = pc.sort_indices(pa.table({"part": part, "term": terms}),
                                sort_keys=[("part", "ascending"), ("term", "ascending")]).to_numpy()
        terms, part, place = terms.take(pa.array(order)), part[order], np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        code = place[code]
        known = pc.is_valid(entries["id"]).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(entries["id"], 0).to_numpy()
        head = np.append(False, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))
        docs = np.count_nonzero(head) + 1
        within = np.lexsort((code, np.cumsum(head)))        # a document's terms by place
        code, tfs = code[within], entries["tf"].to_numpy()[within]
        own = pa.array(np.bincount(code, minlength=len(terms)), pa.int32())
        cells = [_squeeze(ids[known], True), _squeeze(code[known], True), _squeeze(tfs[known])]
        edges = np.searchsorted(part, np.arange(parts + 1))
        out = [{"piece": number, "part": p, "first": at, **{c: x.slice(at, min(_TERMS, hi - at))
                                                          for c, x in (("terms", terms), ("own", own))}}
               for p, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist())) for at in range(lo, hi, _TERMS)]
        out.append(dict(zip(names, [number, None, None, None, None, *cells, len(code), docs])))
        for row in out:
            yield pa.RecordBatch.from_arrays([_cell(row.get(c), c) for c in names], names=names)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The words of texts, a row per word."""
        ids, known, owner, code = [], {}, [], []

        def words() -> pa.RecordBatch:
            listed = pa.array([t.decode() for t in known], pa.string())
            doc = pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), owner))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(doc), pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), listed),
                 pa.array(np.ones(len(code), np.int32))], names=["id", "term", "tf"])

        for at in range(batch.num_rows):
            found = [t for t in _TOKEN.findall(batch["text"][at].as_py()) if t not in stop]
            if found:
                ids.append(batch["id"][at].as_py())
                owner.append(len(found))
                code += [known.setdefault(t, len(known)) for t in found]
            if len(code) >= _WORDS:
                yield words()
                ids, known, owner, code = [], {}, [], []
        if code:
            yield words()

    stop = {w.encode() for w in STOP_WORDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in (part for b in batches for part in (cut(b) if texts else (b,))):
            if not batch.num_rows:
                continue
            term = batch["term"] if texts else pc.dictionary_encode(batch["term"])
            batch = counted(pa.RecordBatch.from_arrays([batch["id"], term, batch["tf"]], names=["id", "term", "tf"]))
            if size >= limit:       # a document's entries follow each other: cut where one begins
                ids = pc.fill_null(batch["id"], 0).to_numpy()
                valid = pc.is_valid(batch["id"]).to_numpy(zero_copy_only=False)
                last = held[-1]["id"][-1].as_py()
                other = ~valid if last is not None else valid
                if last is not None:
                    other |= ids != last
                at = int(other.argmax()) if other.any() else batch.num_rows
                if at:
                    held.append(batch.slice(0, at))
                if at < batch.num_rows:
                    yield from piece(number, held)
                    number, held, size = number + 1, [], 0
                    batch = batch.slice(at)
                else:
                    continue
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from piece(number, held)

    return stored(rows.mapInArrow(run, _PIECES), "pieces")


def _cell(value, name: str) -> pa.Array:
    kind = {"piece": pa.int64(), "part": pa.int32(), "first": pa.int32(), "terms": pa.list_(pa.string()), "own": pa.list_(pa.int32()),
            "entries": pa.int64(), "docs": pa.int64()}.get(name, pa.binary())
    if isinstance(value, pa.Array):
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value).cast(kind)
    return pa.array([value], kind)


def _numbered(pieces: DataFrame, placed: DataFrame, listed: bool = False) -> DataFrame:
    """(block, number, place, code, df): for each part of the terms of each piece their numbers, the
    same in all pieces, and the documents that hold them, in arrays; ``listed``: (term, code, df), a
    row per term. One compressed cell a part and piece moves; a task has one part of all pieces."""
    names = ["part", "block", "number", "first", "sizes", "terms", "own"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                terms, own = (batch[c].slice(at, 1).flatten() for c in ("terms", "own"))
                sizes = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int32)
                text = "".join(terms.to_pylist()).encode()
                cells = [_squeeze(sizes), pa.Codec("zstd", 5).compress(text, asbytes=True), _squeeze(own.to_numpy())]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(at, 1) for c in names[:4]),
                                                  *(pa.array([c], pa.binary()) for c in cells)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, cells = [], []
        for batch in batches:
            places += zip(*(batch[c].to_pylist() for c in names[:4]))
            for sizes, text, own in zip(*(batch[c] for c in names[4:])):
                ends = np.append(0, np.cumsum(_spread(sizes.as_py()), dtype=np.int32)).astype(np.int32)
                text = pa.decompress(text.as_py(), int(ends[-1]), "zstd")
                terms = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), text)
                cells.append((terms, _spread(own.as_py())))
        if not cells:
            return
        every = pa.concat_arrays([x[0] for x in cells]).dictionary_encode()
        order, at = pc.array_sort_indices(every.dictionary).to_numpy(), every.indices.to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = (places[0][0] << 32) + rank
        df = np.bincount(at, np.concatenate([x[1] for x in cells]), len(order)).astype(np.int32)
        if listed:
            yield pa.RecordBatch.from_arrays([every.dictionary, pa.array(code), pa.array(df.astype(np.int64))],
                                             names=["term", "code", "df"])
            return
        start = 0
        for (_, block, number, first), (terms, _) in zip(places, cells):
            own = at[start:start + len(terms)]
            start += len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int32()),
                 pa.array([_squeeze(code[own], True)], pa.binary()), pa.array([_squeeze(df[own])], pa.binary())],
                names=["block", "number", "place", "code", "df"])

    cells = pieces.where(F.col("terms").isNotNull()).join(F.broadcast(placed), "piece").select(
        "part", "block", "number", "first", "terms", "own")
    rows = cells.mapInArrow(pack, "part int, block int, number int, first int, sizes binary, terms binary, own binary")
    return rows.repartitionById(_parts(pieces), "part").mapInArrow(
        run, "term string, code long, df long" if listed else "block int, number int, place int, code binary, df binary")


def _joined(pieces: DataFrame, placed: DataFrame, coded: DataFrame, blocks: int) -> DataFrame:
    """One row per block: the entries of its pieces, by place among the block's distinct terms, and
    these by number and with their df."""
    held = pieces.where(F.col("ids").isNotNull()).join(F.broadcast(placed), "piece").select(
        "block", "number", F.lit(-1).alias("place"), *(F.lit(None).cast("binary").alias(c) for c in ("code", "df")),
        "ids", F.col("code").alias("places"), "tf")
    terms = coded.select("block", "number", "place", "code", "df", *(F.lit(None).cast("binary").alias(c)
                                                                     for c in ("ids", "places", "tf")))
    rows = held.unionByName(terms).repartitionById(blocks, "block").sortWithinPartitions("number", "place")
    names = [f"p_{c}" for c in (*_ENTRIES, *_TERMS_OF)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list[np.ndarray]] = []
        cells, code, df, block = None, [], [], None

        def piece() -> list[np.ndarray]:
            return [*(_spread(c) for c in cells), np.concatenate(code), np.concatenate(df)]

        for batch in batches:
            block = batch["block"][0].as_py() if batch.num_rows else block
            for at, place in enumerate(batch["place"].to_pylist()):
                if place < 0:
                    if cells:
                        done.append(piece())
                    cells, code, df = [batch[c][at].as_py() for c in ("ids", "places", "tf")], [], []
                else:
                    code.append(_spread(batch["code"][at].as_py()))
                    df.append(_spread(batch["df"][at].as_py()))
        if cells:
            done.append(piece())
            codes, first, own = np.unique(np.concatenate([x[3] for x in done]), return_index=True, return_inverse=True)
            starts = np.cumsum([0, *(len(x[3]) for x in done)])
            places = [own[at:][x[1]].astype(np.int32) for at, x in zip(starts, done)]
            whole = [np.concatenate([x[0] for x in done]), np.concatenate(places), np.concatenate([x[2] for x in done]),
                     codes, np.concatenate([x[4] for x in done])[first]]
            if len(whole[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array([_squeeze(x, c[2:] in _RISING)], pa.binary())
                                                    for x, c in zip(whole, names)), pa.array([block], pa.int32())],
                                                 names=[*names, "p_block"])

    return materialize(rows.mapInArrow(run, ", ".join(f"{c} binary" for c in names) + ", p_block int"))


def _placed(pieces: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(piece, number, block) and the number of blocks: the largest piece first, each to the
    block with the fewest entries. There is a piece for ``CHUNK_POSTINGS`` entries or a partition."""
    sizes = pieces.where(F.col("ids").isNotNull()).select("piece", "entries").collect()
    total = sum(r["entries"] for r in sizes)
    blocks = max(1, min(len(sizes), max(-(-total // BLOCK_POSTINGS), least)))
    loads = [(0, b) for b in range(blocks)]
    rows = []
    for number, r in enumerate(sorted(sizes, key=lambda r: (-r["entries"], r["piece"]))):
        load, block = heapq.heappop(loads)
        rows.append((r["piece"], number, block))
        heapq.heappush(loads, (load + r["entries"], block))
    return pieces.sparkSession.createDataFrame(rows, "piece long, number int, block int"), blocks


def _entries(tf: DataFrame, dfs: DataFrame) -> DataFrame:
    """(id, code, tf, df): terms by number; a term of no prior has no number and df 0."""
    return tf.join(dfs, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def _packed(entries: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row per block of documents, all entries of a document in one block, sorted by
    document: the columns as compressed arrays, terms as ``_joined`` has them."""
    rows = entries.select(*(F.col(c).cast("long").alias(c) for c in entries.columns)).repartitionById(
        blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).sortWithinPartitions("id", "code")
    columns = entries.columns
    names = [*_ENTRIES, *_TERMS_OF, *(c for c in columns if c not in ("id", "code", "tf", "df"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        for batch in batches:
            for c in columns:
                # small numbers, but for ids: -1 is a term that no prior has
                values = pc.fill_null(batch[c], -1).to_numpy()
                held[c].append(values if c in ("id", "code") else values.astype(np.int32))
        if held["id"]:
            whole = {c: np.concatenate(held[c]) for c in columns}
            whole["code"], first, place = np.unique(whole["code"], return_index=True, return_inverse=True)
            whole["df"], whole["place"] = whole["df"][first], place.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([_squeeze(whole[c], c in _RISING)], pa.binary()) for c in names],
                                             names=[f"{name}_{c}" for c in names])

    return materialize(rows.mapInArrow(run, ", ".join(f"{name}_{c} binary" for c in names)))


def _squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers of 4 or 8 bytes, compressed with all first bytes first, then all second ones;
    ``rising``: the steps between them."""
    width = values.dtype.itemsize
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return np.array([len(values), width, rising], np.int64).tobytes() + pa.Codec("zstd", 5).compress(planes, asbytes=True)


def _spread(data: bytes) -> np.ndarray:
    size, width, rising = np.frombuffer(data[:24], np.int64)
    raw = pa.decompress(data[24:], int(size * width), "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(width, size)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(np.int64 if width == 8 else np.int32)
    return np.cumsum(values, dtype=values.dtype) if rising else values


def _documents_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of sorted ``ids``, and the place where each begins."""
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[heads], heads


class _Block:
    """A block of priors: a matrix of its frequent terms, inverted lists of the others."""

    def __init__(self, ids: np.ndarray, place: np.ndarray, tf: np.ndarray, code: np.ndarray, df: np.ndarray, n: int):
        self.n = n
        self.ids, heads = _documents_of(ids)
        size = len(self.ids)
        owner = np.repeat(np.arange(size), np.diff(np.append(heads, len(ids))))
        within, outside = ((np.log((m + 1.0) / (df + 1.0)) + 1.0)[place] for m in (n, n + 1.0))
        self.within2, self.outside2 = (np.bincount(owner, (tf * w) ** 2, size) for w in (within, outside))
        order = np.argsort(place, kind="stable")
        self.terms, count = code, np.bincount(place, minlength=len(code))
        self.start = np.append(0, np.cumsum(count))
        self.owner, self.tf = owner[order].astype(np.int32), tf[order].astype(np.float64)
        room = min(len(self.terms), max(1, _MATRIX // size))
        frequent = np.argsort(-count, kind="stable")[:room]
        self.frequent = frequent[count[frequent] >= max(2, _DENSE * size)]
        self.column = np.full(len(self.terms), -1, np.int64)
        self.column[self.frequent] = np.arange(len(self.frequent))
        self.matrix = np.zeros((len(self.frequent), size))
        for row, term in zip(self.matrix, self.frequent):
            own = slice(self.start[term], self.start[term + 1])
            row[self.owner[own]] = self.tf[own]

    @cached_property
    def squares(self) -> np.ndarray:
        return self.matrix ** 2

    def place(self, code: np.ndarray) -> np.ndarray:
        """Each term's place in this block, or -1."""
        at = np.minimum(np.searchsorted(self.terms, code), len(self.terms) - 1)
        return np.where(self.terms[at] == code, at, -1)

    def _product(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, rows: int, power: int) -> np.ndarray:
        """(rows x priors): the sums of ``weight`` times the priors' tf to a power."""
        column = np.where(place >= 0, self.column[place], -1)
        dense = column >= 0
        wide = len(self.frequent)
        left = np.bincount(row[dense] * wide + column[dense], weight[dense], rows * wide).reshape(rows, wide)
        out = left @ (self.matrix if power == 1 else self.squares)
        rare = (place >= 0) & ~dense
        ends = np.searchsorted(row[rare], np.arange(rows + 1))
        term, factor = place[rare], weight[rare]
        for i in np.flatnonzero(ends[1:] > ends[:-1]):
            of = slice(ends[i], ends[i + 1])
            start = self.start[term[of]]
            size = self.start[term[of] + 1] - start
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out[i] += np.bincount(self.owner[at], np.repeat(factor[of], size) * self.tf[at] ** power, len(self.ids))
        return out

    def similarities(self, row, place, tf, df, foreign: np.ndarray) -> np.ndarray:
        """Cosines (candidates x priors). ``row``: each entry's candidate, ascending."""
        n, rows, other = self.n, len(foreign), foreign[row]
        idf = np.log((n + other + 1.0) / (df + other + 1.0)) + 1.0
        own2 = np.bincount(row, (tf * idf) ** 2, rows)
        dot = self._product(row, place, tf * idf ** 2, rows, 1)
        square = np.where(foreign[:, None] > 0, self.outside2, self.within2)
        if foreign.any():
            plain = np.log((n + 2.0) / (df + 1.0)) + 1.0
            square = square + self._product(row, place, np.where(other > 0, idf ** 2 - plain ** 2, 0.0), rows, 2)
        return dot / np.sqrt(np.maximum(own2[:, None] * square, 1e-300))


def _blocked(candidates: DataFrame, priors: DataFrame, n: int, threshold: float, k: int | None,
             groups: int) -> DataFrame:
    """(item_id, related_item_id, sim) of similar pairs, the best ``k`` of each candidate and
    group of blocks (ties by id), or all; with ``k`` = 0 (item_id, links) instead. ``candidates`` and
    ``priors`` are packed; a candidate has ``foreign`` 0/1. Each task of the cartesian product
    meets one packed row of candidates and, one after the other, the packed priors of a group."""
    names = ["item_id", "links"] if k == 0 else ["item_id", "related_item_id", "sim"]

    def pairs(block: _Block, ids, heads, place, tf, df, foreign) -> Iterator[list[np.ndarray]]:
        """With the candidates by number: pairs, or each one's links."""
        heads = np.append(heads, len(place))
        step = max(1, min(_MATRIX // max(1, len(block.ids)), 4096))
        for lo in range(0, len(ids), step):
            own = ids[lo:lo + step]
            edge = heads[lo:lo + len(own) + 1]
            of = slice(edge[0], edge[-1])
            row = np.repeat(np.arange(len(own)), np.diff(edge))
            sim = block.similarities(row, place[of], tf[of].astype(np.float64), df[of].astype(np.float64),
                                     foreign[edge[:-1]])
            hit = (sim >= threshold) & (block.ids != own[:, None])
            if k == 0:
                yield [np.arange(lo, lo + len(own)), hit.sum(axis=1)]
                continue
            r, c = np.nonzero(hit)
            if k is not None:
                order = _best(r, block.ids[c], sim[r, c], k)
                r, c = r[order], c[order]
            yield [r + lo, block.ids[c], sim[r, c]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, held = None, None, None

        def rows(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), *(pa.array(x) for x in found[1:])], names=names)

        for batch in batches:
            for at in range(batch.num_rows):
                cell = {c: batch[c][at].as_py() for c in batch.schema.names}
                if (mine := [cell[f"c_{c}"] for c in (*_ENTRIES, *_TERMS_OF)]) != asked:
                    if held is not None:
                        yield rows(held)
                    asked, held = mine, None
                    every, place, tf, code, df = (_spread(x) for x in mine)
                    foreign = _spread(cell["c_foreign"]) if "c_foreign" in cell else np.zeros(len(every), np.int32)
                    ids, heads = _documents_of(every)
                block = _Block(*(_spread(cell[f"p_{c}"]) for c in (*_ENTRIES, *_TERMS_OF)), n)
                for found in pairs(block, ids, heads, block.place(code)[place], tf, df[place], foreign):
                    if k is None:
                        yield rows(found)
                        continue
                    if k == 0:
                        held = held or [np.arange(len(ids)), np.zeros(len(ids), np.int64)]
                        held[1][found[0]] += found[1]
                        continue
                    held = found if held is None else [np.concatenate(x) for x in zip(held, found)]
                if k and held is not None:
                    order = _best(*held, k)
                    held = [x[order] for x in held]
        if held is not None:
            yield rows(held)

    schema = "item_id long, links long" if k == 0 else "item_id long, related_item_id long, sim double"
    # a task holds the row of the right side and reads through those of the left
    both = priors.coalesce(groups).crossJoin(candidates.hint("shuffle_replicate_nl"))
    return both.mapInArrow(run, schema)


class _Side:
    """The documents of a packed row with their terms' weights, and what a task has found for them."""

    def __init__(self, ids: np.ndarray, place: np.ndarray, tf: np.ndarray, code: np.ndarray, df: np.ndarray, n: int):
        self.ids, heads = _documents_of(ids)
        self.heads = np.append(heads, len(ids))
        self.place, self.tf, self.code = place, tf.astype(np.float64), code
        self.idf = np.log((n + 1.0) / (df + 1.0)) + 1.0
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.heads))
        weight = self.tf * self.idf[place]
        self.square = np.bincount(owner, weight ** 2, len(self.ids))
        self.weight = weight / np.sqrt(self.square)[owner]

    @cached_property
    def copies(self) -> np.ndarray:
        """For each document, how many of smaller id have the same terms."""
        seen: dict[bytes, int] = {}
        out = np.empty(len(self.ids), np.int64)
        for i in np.argsort(self.ids).tolist():
            of = slice(self.heads[i], self.heads[i + 1])
            key = self.place[of].tobytes() + self.tf[of].tobytes()
            out[i] = seen.get(key, 0)
            seen[key] = out[i] + 1
        return out


class _Lists(_Side):
    """The same as a matrix of its frequent terms, in single precision, and inverted lists of the others."""

    def __init__(self, *cells):
        super().__init__(*cells)
        size = len(self.ids)
        owner = np.repeat(np.arange(size), np.diff(self.heads))
        count = np.bincount(self.place, minlength=len(self.code))
        frequent = np.argsort(-count, kind="stable")[:max(1, 4 * _MATRIX // size)]
        frequent = frequent[count[frequent] >= max(2, _DENSE * size)]
        self.column = np.full(len(self.code) + 1, -1)       # the last for a term that is not here
        self.column[frequent] = np.arange(len(frequent))
        column = self.column[self.place]
        dense = column >= 0
        self.matrix = np.zeros((len(frequent), size), np.float32)
        self.matrix[column[dense], owner[dense]] = self.weight[dense]
        order = np.argsort(self.place, kind="stable")
        self.owner, self.sorted = owner[order], self.weight[order]
        self.start = np.append(0, np.cumsum(count))
        # all numbers are positive, so that sums of F products in single precision are off by this share at most
        self.error = (len(frequent) + 16) * 2.0 ** -24

    def placed(self, other: _Side) -> np.ndarray:
        """The place here of each entry's term, or -1."""
        at = np.minimum(np.searchsorted(self.code, other.code), len(self.code) - 1)
        return np.where(self.code[at] == other.code, at, -1)[other.place]

    def cosines(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """(rows x documents), each off by the share ``error`` of itself at most."""
        column = self.column[place]
        dense = column >= 0
        left = np.zeros((rows, len(self.matrix)), np.float32)
        left[row[dense], column[dense]] = weight[dense]
        out = left @ self.matrix
        rare = (place >= 0) & ~dense
        ends = np.searchsorted(row[rare], np.arange(rows + 1))
        term, factor = place[rare], weight[rare]
        first = self.start[term]
        size = self.start[term + 1] - first
        for i in np.flatnonzero(ends[1:] > ends[:-1]):
            of = slice(ends[i], ends[i + 1])
            many = size[of]
            until = np.cumsum(many)
            at = np.repeat(first[of] - (until - many), many) + np.arange(until[-1])
            out[i] += np.bincount(self.owner[at], np.repeat(factor[of], many) * self.sorted[at], len(self.ids))
        return out

    def exact(self, other: _Side, place: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cosines of the pairs (r, c), r ascending: documents of ``other`` and of this."""
        out, wide = np.empty(len(r)), np.zeros(len(self.code) + 1)
        edges = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r)) if len(r) else [0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = slice(other.heads[r[lo]], other.heads[r[lo] + 1])
            wide[place[own]] = other.tf[own] * other.idf[other.place[own]] ** 2
            wide[-1] = 0.0
            for a in range(lo, hi, 4096):
                few = c[a:min(a + 4096, hi)]
                size = self.heads[few + 1] - self.heads[few]
                until = np.cumsum(size)
                at = np.repeat(self.heads[few] - (until - size), size) + np.arange(until[-1])
                out[a:a + len(few)] = np.add.reduceat(wide[self.place[at]] * self.tf[at], until - size)
            wide[place[own]] = 0.0
        return out / np.sqrt(np.maximum(other.square[r] * self.square[c], 1e-300))


def _best(r: np.ndarray, related: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best of each ``r``, by ``r``."""
    order = np.lexsort((related, -np.round(sim, 10), r))
    head = np.flatnonzero(np.append(True, np.diff(r[order]) != 0)) if len(r) else order
    rank = np.arange(len(r)) - np.repeat(head, np.diff(np.append(head, len(r))))
    return order[rank < k]


class _Found:
    """What a task has found for the documents of a block: links, or the best ``k`` and, for each
    document, ``k`` numbers that so many others reach."""

    def __init__(self, ids: np.ndarray, k: int, threshold: float):
        self.ids, self.k, self.threshold = ids, k, threshold
        self.links = np.zeros(len(ids), np.int64)
        self.tops = np.zeros((k, len(ids)), np.float32)
        self.rows: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.new: list[tuple[np.ndarray, ...]] = []

    def raise_to(self, maxima: np.ndarray, at: slice) -> None:
        """``maxima``: (any x documents) largest cosines over groups of others that are in no other group."""
        both = np.concatenate([self.tops[:, at], maxima])
        self.tops[:, at] = np.partition(both, len(both) - self.k, axis=0)[len(both) - self.k:]

    def least(self, at: slice, error: float) -> np.ndarray:
        """The computed cosine from which another may be among the best of each document."""
        low = np.maximum(self.tops[:, at].min(axis=0) * (1 - error), self.threshold)
        return ((low / (1 + error) - 2e-9) * (1 - 2e-7)).astype(np.float32)

    def add(self, doc: np.ndarray, related: np.ndarray, sim: np.ndarray) -> None:
        kept = sim >= self.threshold
        self.new.append((doc[kept], related[kept], sim[kept]))
        if sum(len(x[0]) for x in self.new) > 4 * self.k * len(self.ids):
            self._settle()

    def _settle(self) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, *self.new)]
        order = _best(*rows, self.k)
        self.rows, self.new = [x[order] for x in rows], []

    def columns(self) -> list[np.ndarray]:
        if self.k == 0:
            return [self.ids, self.links]
        self._settle()
        return [self.ids[self.rows[0]], *self.rows[1:]]


def _mutual(packed: DataFrame, n: int, threshold: float, k: int, groups: int) -> DataFrame:
    """``_blocked`` where all documents ask all (``k`` best of each, or with 0 the links): a cosine
    serves both documents, so that two blocks meet once. Each task of the cartesian product has a
    group of blocks on each side; a document is in ``groups`` + 1 tasks at most, whatever their number.
    Cosines are made in single precision with a known error; of those that may be among the best, or
    on either side of the threshold, the exact one is made."""
    names = ["item_id", "links"] if k == 0 else ["item_id", "related_item_id", "sim"]
    schema = "item_id long, links long" if k == 0 else "item_id long, related_item_id long, sim double"

    def peaks(sim: np.ndarray, most: int) -> np.ndarray:
        """(groups of rows x columns): the largest of each column in groups of rows."""
        many = min(len(sim), most)
        high = len(sim) // many
        out = sim[:many * high].reshape(many, high, -1).max(axis=1)
        if many * high < len(sim):
            out[-1] = np.maximum(out[-1], sim[many * high:].max(axis=0))
        return out

    def meet(here: _Lists, there: _Side, mine: _Found, theirs: _Found) -> None:
        """``here`` and ``there``, documents by documents; the same block if the two are one."""
        same, error = here is there, here.error
        place = here.placed(there)
        every = slice(None)
        step = max(1, min(_MATRIX // max(1, len(here.ids)), 4096))
        for lo in range(0, len(there.ids), step):
            own = slice(lo, min(lo + step, len(there.ids)))
            rows = own.stop - lo
            of = slice(there.heads[lo], there.heads[own.stop])
            row = np.repeat(np.arange(rows), np.diff(there.heads[lo:own.stop + 1]))
            sim = here.cosines(row, place[of], there.weight[of], rows)
            if same:
                sim[np.arange(rows), np.arange(lo, own.stop)] = -1.0
            if k == 0:
                sure = sim >= np.float32(threshold / (1 - error) * (1 + 2e-7))
                near = np.flatnonzero((sim >= np.float32(threshold / (1 + error) * (1 - 2e-7))) & ~sure)
                r, c = near // sim.shape[1], near % sim.shape[1]
                hit = here.exact(there, place, r + lo, c) >= threshold
                for found, at, counted, part in ((theirs, r + lo, np.count_nonzero(sure, axis=1), own),
                                                 (mine, c, None if same else np.count_nonzero(sure, axis=0), every)):
                    if counted is not None:
                        found.links[part] += counted
                        found.links += np.bincount(at[hit], minlength=len(found.links))
                continue
            theirs.raise_to(peaks(sim.T, max(16, 2 * k)), own)
            asked = sim >= theirs.least(own, error)[:, None]
            if same:
                either = asked
            else:
                mine.raise_to(peaks(sim, max(4, k)), every)
                asks = sim >= mine.least(every, error)
                either = asked | asks
            at = np.flatnonzero(either)
            r, c = at // sim.shape[1], at % sim.shape[1]
            # of documents with the same terms the first by id are enough
            first = asked.ravel()[at] & (here.copies[c] <= k)
            second = np.zeros(len(at), bool) if same else asks.ravel()[at] & (there.copies[r + lo] <= k)
            kept = (first | second) & (there.ids[r + lo] != here.ids[c])
            r, c, first, second = r[kept] + lo, c[kept], first[kept], second[kept]
            cosine = here.exact(there, place, r, c)
            theirs.add(r[first], here.ids[c[first]], cosine[first])
            if not same:
                mine.add(c[second], there.ids[r[second]], cosine[second])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Found] = {}
        number, here = None, None

        def rows(found: _Found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found.columns()], names=names)

        for batch in batches:
            for at in range(batch.num_rows):
                left, right = batch["p_block"][at].as_py(), batch["c_block"][at].as_py()
                if left != number:
                    if number in held:
                        yield rows(held.pop(number))
                    number = left
                    here = _Lists(*(_spread(batch[f"p_{c}"][at].as_py()) for c in (*_ENTRIES, *_TERMS_OF)), n)
                there = here if right == left else _Side(
                    *(_spread(batch[f"c_{c}"][at].as_py()) for c in (*_ENTRIES, *_TERMS_OF)), n)
                for block, side in ((left, here), (right, there)):
                    if block not in held:
                        held[block] = _Found(side.ids, k, threshold)
                meet(here, there, held[left], held[right])
        for found in held.values():
            yield rows(found)

    asked = packed.select(*(F.col(f"p_{c}").alias(f"c_{c}") for c in (*_ENTRIES, *_TERMS_OF, "block")))
    both = packed.coalesce(groups).join(asked.coalesce(groups).hint("shuffle_replicate_nl"),
                                        F.col("p_block") <= F.col("c_block"))
    return both.mapInArrow(run, schema)


def _search(candidates: DataFrame | None, tf: DataFrame, threshold: float, k: int | None,
            adjacent: bool = False) -> DataFrame:
    """``_blocked`` for the candidates' terms (id, term, tf, foreign 0/1; None: the documents of
    ``tf`` themselves) against the documents of ``tf`` (``adjacent``: as ``_words`` or ``_texts`` make them); an
    id is never its own prior, and a null id is linked with nothing."""
    ship_package(tf.sparkSession)
    pieces = _pieces(tf, adjacent)
    n = pieces.agg(F.sum("docs")).first()[0] or 0
    cores = tf.sparkSession.sparkContext.defaultParallelism
    sides = math.isqrt(2 * _WAVES * cores - 1) + 1      # so that half of their square are enough tasks
    placed, blocks = _placed(pieces, min(sides if candidates is None else cores, n // 256))
    packed = _joined(pieces, placed, _numbered(pieces, placed), blocks)

    def groups(chunks: int) -> int:
        return min(blocks, -(-_WAVES * cores // chunks))

    if candidates is None:
        found = _mutual(packed, n, threshold, k, min(blocks, sides)).repartition(_parts(tf), "item_id")
        if k == 0:
            return found.groupBy("item_id").agg(F.sum("links").alias("links"))
        return top_k(found, k).select("item_id", "related_item_id", "sim")
    dfs = stored(_numbered(pieces, placed, listed=True), "terms")
    candidates = stored(candidates, "candidates")
    foreign = candidates.groupBy("id").agg(F.max("foreign").alias("foreign"))
    asked, size = _entries(candidates.select("id", "term", "tf"), dfs).join(foreign, "id"), candidates.count()
    chunks = max(1, -(-size // CHUNK_POSTINGS), min(cores, size // 65536))
    return _blocked(_packed(asked.select("id", "code", "tf", "df", "foreign"), chunks, "c"), packed, n, threshold, k,
                    groups(chunks))


def _asked(tf: DataFrame, candidates: DataFrame) -> DataFrame:
    return tf.join(candidates.select("id").distinct(), "id", "left_semi").withColumn("foreign", F.lit(0))


def cosine_pairs(tf: DataFrame, candidates: DataFrame, threshold: float = 0.08) -> DataFrame:
    """(item_id, related_item_id, unrounded sim) with cosine >= threshold: the documents of
    ``tf`` whose id is in ``candidates`` (id) against all documents of ``tf``."""
    tf = stored(tf, "tf")
    return _search(_asked(tf, candidates), tf, threshold, None)


def link_counts(tf: DataFrame, threshold: float = 0.08) -> DataFrame:
    """(item_id, links): for every document of ``tf`` the number of others with cosine >=
    threshold. Counts are added up per block, so no pair becomes a row."""
    return _search(None, tf, threshold, 0)


def top_k(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Best k per item: similarity desc (rounded to 10 places so float summation
    order cannot flip ties), then prior id asc. Adds ``rank`` and the reported
    ``similarity`` rounded to 4 places after ranking."""
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round("sim", 10)), F.asc("related_item_id"))
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("similarity", F.round("sim", 4)))


def related_pairs(candidates: DataFrame, priors: DataFrame, top: int = 3,
                  min_similarity: float = 0.08, id_col: str = "item_id", known: DataFrame | None = None) -> DataFrame:
    """(item_id, related_item_id, similarity, rank): related priors for every candidate in one
    job; a candidate is never its own prior, and other candidates do not change its
    similarities (N4). Ids are unique on each side. ``known``: a written table of the priors' ids,
    where reading them off the priors themselves takes long."""
    asked = None
    repeated = (priors if known is None else known).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    # a null id, and the rows of one id, are one document
    tf = term_frequency(priors, id_col) if repeated else _texts(priors, id_col)
    if candidates is not priors or repeated:
        known = priors.select(F.col(id_col).alias("id"), F.lit(0).alias("foreign"))
        asked = (term_frequency(candidates, id_col).join(known, "id", "left")
                 .withColumn("foreign", F.coalesce("foreign", F.lit(1))))
    return top_k(_search(asked, tf, min_similarity, top, not repeated), top).select(
        "item_id", "related_item_id", "similarity", "rank")


def with_priors(pairs: DataFrame, priors: DataFrame, id_col: str = "item_id") -> DataFrame:
    """``pairs`` with related_title, related_url and, where ``priors`` have it,
    related_summary. A long summary is often many items' related one, so the texts are joined
    where they are shown, not stored with the pairs."""
    texts = [c for c in ("title", "url", "summary") if c in priors.columns]
    info = priors.select(F.col(id_col).alias("related_item_id"), *(F.col(c).alias(f"related_{c}") for c in texts))
    return pairs.join(info, "related_item_id").select(
        "item_id", "related_item_id", "similarity", "rank", *(f"related_{c}" for c in texts))


def find_related(candidates: DataFrame, priors: DataFrame, top: int = 3,
                 min_similarity: float = 0.08, id_col: str = "item_id") -> DataFrame:
    """``related_pairs`` with the priors' titles, URLs and summaries."""
    return with_priors(related_pairs(candidates, priors, top, min_similarity, id_col), priors, id_col)
