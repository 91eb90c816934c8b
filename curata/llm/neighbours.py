"""Operator 9: nearest neighbours by an inverted multi-index.

Each half of the vectors is quantised by its own ``CENTROIDS`` centroids (Lloyd's method on
a bounded sample, ``SAMPLE``); a pair of centroids is a cell, and every vector is entered in
one. A query sorts the centroids of each half by inner product and walks the pairs by their
sum, best first, with a heap, until the entries of the cells seen reach ``SHARE`` of all
(entries of a cell beyond four times the mean count no more, so that a crowded cell does not
use up a query's walk). All entries of these cells are ranked by their exact inner product.

Plan: vectors are range-sorted by cell into shards of at most ``SHARD`` rows, queries are
gathered in blocks of ``BLOCK``; a block meets each shard that one of its queries visits
(an equi-join on the shard number), a task multiplies the two matrices and keeps each
query's best k over its shards (for ``HELD`` blocks at a time), and a window over (query, rank) merges the shards. A cell with a third of
all vectors is many shards. Only the centroids, the entries per cell (at most CENTROIDS^2
numbers) and the cells of each shard pass through the driver.

Recall depends on the vectors: near-uniform ones, as in the test tables, need about half of
the entries for 0.9. SHARE is set for them; clustered vectors allow much less.

Vectors are kept in the column's own precision and multiplied in doubles.

Defined results: vectors that are null, zero, not of the usual length, or hold null or
non-finite numbers take no part; ties go to the smaller id; fewer candidates than k are all
returned; entries with the query's own id are left out; repeated rows are entries and
queries of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import stage

CENTROIDS = 32
SAMPLE = 20_000
ROUNDS = 12
SHARE = 0.6
LEAST = 20  # entries to walk at least, for each result wanted
SHARD = 4096
BLOCK = 1024
CROWDED = 4.0
HELD = 64  # query blocks whose best rows a task merges over its shards


def _matrix(column, dtype: str) -> np.ndarray:
    rows = list(column)
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1).astype(np.float64)


def lloyd(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``rows`` (fewer rows than k: the rows)."""
    rng = np.random.default_rng(7)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        for j in np.unique(own):
            centres[j] = rows[own == j].mean(axis=0)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None] - 2 * rows @ centres.T, axis=1)


def cells_of(rows: np.ndarray, centres: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = centres[0].shape[1]
    return (_nearest(rows[:, :half], centres[0]) * len(centres[1])
            + _nearest(rows[:, half:], centres[1])).astype(np.int64)


def walk(first: np.ndarray, second: np.ndarray, weight: np.ndarray, enough: float) -> list[int]:
    """Cells by descending sum of the two halves' scores until their weights reach ``enough``."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    sa, sb = first[a], second[b]
    heap, seen, held, wide = [(-(sa[0] + sb[0]), 0, 0)], [], 0.0, len(second)
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * wide + int(b[j])
        if weight[cell]:
            seen.append(cell)
            held += weight[cell]
        if j + 1 < wide:
            heapq.heappush(heap, (-(sa[i] + sb[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(sa[i + 1] + sb[0]), i + 1, 0))
    return seen


def _width(vectors: DataFrame) -> str:
    """The number format that keeps the column's values: float32 for floats, else doubles."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def _usable(vectors: DataFrame, width: str) -> DataFrame:
    """(vec_id, vector as bytes of ``width``) of the rows that take part, staged."""
    def run(batches):
        for batch in batches:
            keys, out = [], []
            for key, values in zip(batch["vec_id"], batch["embedding"]):
                row = np.array([np.nan if x is None else x for x in values], np.float64)
                if len(row) and np.isfinite(row).all() and row.any():
                    keys.append(key)
                    out.append(row.astype(width).tobytes())
            yield pd.DataFrame({"vec_id": keys, "vector": out})

    rows = vectors.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return stage(rows.mapInPandas(run, "vec_id long, vector binary"), "vectors")


def search(vectors: DataFrame, is_query, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows found for each row of ``vectors``
    (vec_id, embedding) that meets the condition ``is_query``."""
    spark = vectors.sparkSession
    width = _width(vectors)
    rows = _usable(vectors, width)
    sizes = rows.groupBy(F.length("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.length("vector") == sizes["n"])
    total = sizes["count"]
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 20)) < int(min(1.0, SAMPLE / total) * (1 << 20))

    def train(batches):
        batches = list(batches)
        if batches:
            drawn = pd.concat(batches).sort_values("vec_id")
            x = _matrix(drawn["vector"], width)
            for half, part in enumerate(np.array_split(x, [x.shape[1] // 2], axis=1)):
                for c in lloyd(part, CENTROIDS):
                    yield pd.DataFrame({"half": [half], "centre": [c.astype("<f8").tobytes()]})

    fitted = rows.where(drawn).repartition(1).mapInPandas(train, "half int, centre binary").collect()
    if not fitted:  # a handful of rows may miss the sample: then all of them are it
        fitted = rows.limit(CENTROIDS).repartition(1).mapInPandas(train, "half int, centre binary").collect()
    centres = tuple(_matrix([r["centre"] for r in fitted if r["half"] == h], "<f8") for h in (0, 1))
    n_cells = len(centres[0]) * len(centres[1])

    def enter(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells_of(_matrix(batch["vector"], width), centres))

    entered = stage(rows.mapInPandas(enter, "vec_id long, vector binary, cell long"), "cells")
    weight = np.zeros(n_cells)
    for r in entered.groupBy("cell").count().collect():
        weight[r["cell"]] = r["count"]
    weight = np.minimum(weight, CROWDED * max(1.0, weight[weight > 0].mean()))
    enough = min(weight.sum(), max(share * weight.sum(), LEAST * k))

    def shard(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            while len(held) >= SHARD:
                yield pack(held.iloc[:SHARD])
                held = held.iloc[SHARD:]
        if held is not None and len(held):
            yield pack(held)

    def pack(part):
        return pd.DataFrame({"vec_ids": [part["vec_id"].tolist()], "cells": [part["cell"].tolist()],
                             "entries": [b"".join(part["vector"])]})

    shards = (entered.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
              .coalesce(-(-total // SHARD))  # shards follow the rows, not the session's partitions
              .mapInPandas(shard, "vec_ids array<long>, cells array<long>, entries binary")
              .withColumn("shard", F.monotonically_increasing_id()))
    shards = stage(shards, "shards")
    held_by = {}
    for r in shards.select("shard", F.array_distinct("cells").alias("cells")).collect():
        for c in r["cells"]:
            held_by.setdefault(c, []).append(r["shard"])
    shared = spark.sparkContext.broadcast((centres, weight, enough, held_by))

    def gather(batches):
        centres, weight, enough, held_by = shared.value
        half, held = centres[0].shape[1], None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            while held is not None and len(held):
                part, held = held.iloc[:BLOCK], held.iloc[BLOCK:]
                q = _matrix(part["vector"], width)
                first, second = q[:, :half] @ centres[0].T, q[:, half:] @ centres[1].T
                visits = [walk(x, y, weight, enough) for x, y in zip(first, second)]
                bits = np.zeros((len(q), len(weight)), bool)
                for i, cells in enumerate(visits):
                    bits[i, cells] = True
                wanted = sorted({s for c in np.flatnonzero(bits.any(axis=0)) for s in held_by[int(c)]})
                yield pd.DataFrame({"query_ids": [part["vec_id"].tolist()], "queries": [b"".join(part["vector"])],
                                    "visits": [np.packbits(bits, axis=1).tobytes()], "wanted": [wanted]})

    queries = entered.where(is_query).select("vec_id", "vector")
    blocks = stage(queries.coalesce(max(1, -(-queries.count() // BLOCK))).mapInPandas(
        gather, "query_ids array<long>, queries binary, visits binary, wanted array<long>")
        .withColumn("block", F.monotonically_increasing_id()), "query-blocks")

    def rank(batches):
        held = {}  # a task meets many shards of a block: k rows a query leave it, not k a shard
        for batch in batches:
            for r in batch.itertuples(index=False):
                q = np.frombuffer(r.queries, width).reshape(len(r.query_ids), -1).astype(np.float64)
                x = np.frombuffer(r.entries, width).reshape(-1, q.shape[1]).astype(np.float64)
                ids, cells = np.asarray(r.vec_ids, np.int64), np.asarray(r.cells, np.int64)
                own = np.asarray(r.query_ids, np.int64)
                bits = np.unpackbits(np.frombuffer(r.visits, np.uint8).reshape(len(q), -1), axis=1)
                scores = q @ x.T
                scores[(bits[:, cells] == 0) | (own[:, None] == ids[None])] = -np.inf
                out = []
                for i in range(len(q)):
                    best = np.flatnonzero(scores[i] > -np.inf)
                    if len(best) > k:
                        least = np.partition(scores[i][best], -k)[-k]
                        best = best[scores[i][best] >= least]
                    best = best[np.lexsort((ids[best], -scores[i][best]))][:k]
                    out.append(pd.DataFrame({"query": i, "query_id": own[i], "vec_id": ids[best],
                                             "score": scores[i][best]}))
                best = pd.concat(out).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
                if r.block in held:
                    best = pd.concat([held[r.block], best]).sort_values(
                        ["query", "score", "vec_id"], ascending=[True, False, True]).groupby("query").head(k)
                held[r.block] = best.assign(block=r.block)
                if len(held) > HELD:
                    yield from held.values()
                    held = {}
        yield from held.values()

    met = blocks.select("block", "query_ids", "queries", "visits", F.explode("wanted").alias("shard")).join(shards, "shard")
    found = met.mapInPandas(rank, "block long, query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def neighbours_of_twentieths(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
