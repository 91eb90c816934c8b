"""Operator 3: near-duplicates by a MinHash LSH forest.

A document's set is its distinct word shingles (fewer words than a shingle: the whole
sequence). Two documents are linked when 100 * |intersection| >= percent * |union|;
components of links are groups.

* Documents with equal sets collapse to one representative first, by partial aggregation.
* The forest: each representative has ``TREES`` signatures of ``DEPTH`` minimum hashes. Each
  tree is one sorted order of the signatures, by its own hashes and then by those of the next
  tree, ``ORDER_DEPTH`` in all, so rows of a dense region are still told apart. A document's
  candidates are its ``NEIGHBOURS``
  next ones in the order, the longest common prefixes, as long as the prefix is at least
  ``LEAST_DEPTH`` deep; so a sparse region is searched at that depth and a dense one only
  deeper. The first document of a region in a task is one more candidate of all its others,
  which holds a dense region together. These candidates are linear in the documents, and a
  region of any size is spread by the range sort.
* Links are confirmed on the full sets, recomputed for candidates only: first each
  document's strongest candidates, then every candidate pair that these did not connect.
* A region (equal first ``LEAST_DEPTH`` hashes in a tree) with more rows than a window that
  is still in several components is finished in two steps. Its row with the most links meets
  all its others, which joins an original and copies edited in different places. Then every
  pair of two components meets: a region of over ``2 * BLOCK`` rows is cut into slices of
  about ``BLOCK``, those of its largest component apart, and each two slices that may hold
  such a pair are one cell, so no group grows with the region. In a cell pairs are compared
  on their full sets unless their signatures agree in too few places (a true link has so few
  with less than 1e-8). So each pair that shares a region is linked, connected otherwise or
  compared, once. Only links leave a task; the work is quadratic in rows that share regions
  but have no links, and is spread over the cells.

A pair of similarity 0.8 shares a prefix of four with probability 0.41 a tree, so 20 trees
miss it with 3e-5 (0.9: 1e-9). The range sort's tasks hand their first and last rows to one
small pass (``2 * NEIGHBOURS`` rows a task) so that no neighbour is lost at a boundary.

Defined results: texts without words (or null) have an empty set, are linked with nothing
and kept; rows with a null doc_id take no part (component null, kept); repeated rows share
a component; ties go to the smallest doc_id; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import combine, hash_words, mix, stage, text_slices, whole_text
from curata.operators.components import star_components

TREES = 20
DEPTH = 6
ORDER_DEPTH = 2 * DEPTH
LEAST_DEPTH = 4
NEIGHBOURS = 4
SALTS = 16
BLOCK = 512
_CHUNK = 4096
_U64 = np.uint64
_A = mix(np.arange(1, TREES * DEPTH + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)
_B = mix(np.arange(1, TREES * DEPTH + 1, dtype=_U64) * _U64(0xC2B2AE3D27D4EB4F))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(words):
        return words
    return np.unique(combine(words, min(size, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minimum hashes (32 bits each) of a set that is not empty."""
    least = np.full(TREES * DEPTH, ~_U64(0))
    for i in range(0, len(shingles), _CHUNK):
        part = shingles[None, i:i + _CHUNK] * _A[:, None]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> _U64(32)).astype(np.uint32)


def _sets(texts, size: int):
    return [shingle_set(w, size) for w in hash_words([t.encode() for t in texts])]


def _described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set size, fingerprint of the set, signature (both null for the empty set)."""
    def run(batches):
        for batch, texts in text_slices(batches):
            sets = _sets(texts, size)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n", "fingerprint", "signature"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                   whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, fingerprint binary, signature binary")


class _Scan:
    """Candidates among rows that come in a tree's sorted order, batch by batch."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tail = None   # the last NEIGHBOURS rows
        self.first = None  # the first row of the current region

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """rows: tree, key, node, n (and anything else). Pairs of each row with earlier ones."""
        carried = [x for x in (self.first, self.tail) if x is not None and len(x)]
        before = sum(map(len, carried))
        every = pd.concat([*carried, rows], ignore_index=True)
        key = np.frombuffer(b"".join(every["key"]), ">u4").reshape(len(every), ORDER_DEPTH)
        region = np.column_stack([every["tree"].to_numpy(), key[:, :LEAST_DEPTH].astype(np.int64)])
        node, n = every["node"].to_numpy(), every["n"].to_numpy()
        place = np.arange(len(every))
        new = np.ones(len(every), bool)
        new[1:] = (region[1:] != region[:-1]).any(axis=1)
        start = np.maximum.accumulate(np.where(new, place, 0))
        pairs = [(start, place, start < place - NEIGHBOURS)]
        for step in range(1, NEIGHBOURS + 1):
            pairs.append((np.maximum(place - step, 0), place, place - step >= start))
        out = []
        for i, j, ok in pairs:
            ok = ok & (j >= before) & (100 * np.minimum(n[i], n[j]) >= self.percent * np.maximum(n[i], n[j]))
            ok &= node[i] != node[j]
            out.append(np.column_stack([node[i][ok], node[j][ok]]))
        pairs = np.concatenate(out)
        last = int(start[-1])
        self.first = every.iloc[[last]] if last < len(every) - NEIGHBOURS else None
        self.tail = every.iloc[-NEIGHBOURS:]
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, trees): pairs of ``nodes`` (node, n, signature) with a < b, and in how many
    trees they are neighbours."""
    width = 4 * DEPTH
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    # the last tree goes on with the first one's hashes
    rows = nodes.select("node", "n", F.concat("signature", F.substring("signature", 1, width)).alias("ring"), trees).select(
        "tree", F.substring("ring", F.col("tree") * width + 1, F.lit(4 * ORDER_DEPTH)).alias("key"), "node", "n")

    def run(batches):
        task, at, scan, tail = TaskContext.get().partitionId(), 0, _Scan(percent), None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.assign(task=task, at=np.arange(at, at + len(batch)))
            if at < NEIGHBOURS:
                yield batch.iloc[:NEIGHBOURS - at].assign(a=None, b=None)[_COLUMNS]
            at += len(batch)
            pairs = scan.feed(batch)
            yield pairs.assign(tree=None, key=None, node=None, n=None, task=None, at=None)[_COLUMNS]
            tail = batch if tail is None else pd.concat([tail, batch])
            tail = tail.iloc[-NEIGHBOURS:]
        if tail is not None:
            yield tail[tail["at"] >= NEIGHBOURS].assign(a=None, b=None)[_COLUMNS]

    ordered = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = stage(ordered.mapInPandas(run, _SCANNED), "forest")

    def across(batches):
        rows = [b for b in batches if len(b)]
        if rows:
            rows = pd.concat(rows).sort_values(["task", "at"], ignore_index=True)
            yield _Scan(percent).feed(rows)

    edges = found.where("node is not null").select("tree", "key", "node", "n", "task", "at")
    met = edges.repartition(1).mapInPandas(across, "a long, b long")  # 2 * NEIGHBOURS rows a task
    pairs = found.where("a is not null").select("a", "b").unionByName(met)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("trees"))


_COLUMNS = ["a", "b", "tree", "key", "node", "n", "task", "at"]
_SCANNED = "a long, b long, tree int, key binary, node long, n long, task int, at long"


def full_sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the sets of the documents in ``wanted`` (doc_id)."""
    def make(batches):
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s.tobytes() for s in _sets(texts, size)], pa.binary())], ["node", "shingles"])

    texts = (docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
             .join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return stage(texts.mapInArrow(make, "node long, shingles binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = np.frombuffer(x, _U64), np.frombuffer(y, _U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.loc[ok, ["a", "b"]]

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = full_sets(wanted, docs, size)
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"))
    return both.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")


def _strongest(pairs: DataFrame) -> DataFrame:
    """Each document's candidate that most trees found, from either side."""
    best = [pairs.groupBy(one).agg(F.max(F.struct("trees", (-F.col(other)).alias("o"))).alias("m"))
            .select(F.least(one, -F.col("m.o")).alias("a"), F.greatest(one, -F.col("m.o")).alias("b"))
            for one, other in (("a", "b"), ("b", "a"))]
    return best[0].unionByName(best[1]).distinct()


def _salted(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """``rows`` with the columns of their region; salted, as one may have a third of all rows."""
    spread = regions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(
        spread, ["region", "salt"]).drop("salt")


def dense_rows(nodes: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """region, tree, node, n, root, hub (node, n, root) of the rows of regions that are larger than
    a window and in several components; the hub is the region's row with the most links."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    prefix = F.substring("signature", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * LEAST_DEPTH))
    rows = (nodes.join(groups, "node", "left").join(degrees, "node", "left")
            .select("node", "n", "signature", F.coalesce("root", "node").alias("root"),
                    F.coalesce("degree", F.lit(0)).alias("degree"), trees)
            .select(F.xxhash64("tree", prefix).alias("region"), "tree", "node", "n", "root", "degree"))
    regions = (rows.groupBy("region").agg(
        F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.max(F.struct("degree", "node", "n", "root")).alias("hub"))
        .where((F.col("m") > NEIGHBOURS + 1) & (F.col("low") < F.col("high"))).select("region", "hub"))
    return _salted(rows.drop("degree"), regions)


def hub_pairs(dense: DataFrame, percent: int) -> DataFrame:
    """(a, b): the hub of each region with the region's rows of other components."""
    near = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    return (dense.where((F.col("root") != F.col("hub.root")) & near)
            .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())


def open_cells(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """region, i, j, tree, node, n, root, left, right: the rows of each region that is still in
    several components, dealt to cells. A cell's left rows meet its right rows (a row may be
    both); each two rows of different components meet in one cell of their region."""
    rows = (dense.select("region", "tree", "node", "n").join(groups, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    parts = rows.groupBy("region", "root").agg(F.count("*").alias("c"))
    slices = [F.ceil(F.expr(c) / BLOCK).cast("int").alias(name) for c, name in (("m - top.c", "minors"), ("top.c", "majors"))]
    regions = (parts.groupBy("region").agg(F.count("*").alias("parts"), F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"))
               .where("parts > 1").select("region", F.col("top.root").alias("major"), "m", *slices))
    minor = F.col("root") != F.col("major")
    place = F.xxhash64("node", F.lit(1))
    at = F.when(minor, F.pmod(place, "minors")).otherwise(F.col("minors") + F.pmod(place, "majors")).cast("int")

    def cell(i, j, left, right):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"), right.alias("right"))

    at_once = F.array(cell(F.lit(0), F.lit(0), minor, F.lit(True)))
    with_all = F.transform(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1), lambda k: cell(
        F.least("at", k), F.greatest("at", k), F.col("at") <= k, F.col("at") >= k))
    with_minors = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda k: cell(
        k, F.col("at"), F.lit(False), F.lit(True)))
    return (_salted(rows, regions).withColumn("at", at)
            .withColumn("cell", F.explode(F.when(F.col("m") <= 2 * BLOCK, at_once).when(minor, with_all).otherwise(with_minors)))
            .select("region", "cell.i", "cell.j", "tree", "node", "n", "root", "cell.left", "cell.right"))


def open_links(dense: DataFrame, nodes: DataFrame, groups: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the links among all pairs of a region in different components."""
    places, share = TREES * DEPTH, percent / 100
    limit = places * share - 6 * (places * share * (1 - share)) ** 0.5
    rows = stage(open_cells(dense, groups), "open-rows")
    sets = full_sets(rows.select(F.col("node").alias("doc_id")).distinct(), docs, size)
    met = rows.join(nodes.select("node", "signature").join(sets, "node"), "node")

    def run(rows):
        keys = np.frombuffer(b"".join(rows["signature"]), ">u4").reshape(len(rows), places)
        marks = keys.astype(np.uint8).T.copy()
        prefixes = keys.reshape(len(rows), TREES, DEPTH)[:, :rows["tree"].iloc[0], :LEAST_DEPTH]
        sets = [np.frombuffer(x, _U64) for x in rows["shingles"]]
        node, n, root, left, right = (rows[c].to_numpy() for c in ("node", "n", "root", "left", "right"))
        home, away, out = np.flatnonzero(right), np.flatnonzero(left), []
        here = marks[:, home]
        for at in range(0, len(away), 128):
            some = away[at:at + 128]
            same = np.zeros((len(some), len(home)), np.uint8)
            for place in range(places):
                same += marks[place, some][:, None] == here[place]
            ok = (same >= limit) & (root[some][:, None] != root[home])
            ok &= 100 * np.minimum(n[some][:, None], n[home]) >= percent * np.maximum(n[some][:, None], n[home])
            ok &= ~left[home] | (node[some][:, None] < node[home])  # two rows on both sides meet twice
            for x, found in zip(some, ok):
                others = home[found]  # less those that meet in the region of an earlier tree
                others = others[~(prefixes[others] == prefixes[x]).all(axis=2).any(axis=1)]
                for i in range(0, len(others), 256):
                    part = [sets[y] for y in others[i:i + 256]]
                    every, sizes = np.concatenate(part), np.array([len(p) for p in part])
                    hits = sets[x][np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)] == every
                    both = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
                    linked = others[i:i + 256][100 * both >= percent * (len(sets[x]) + sizes - both)]
                    out += [(min(node[x], y), max(node[x], y)) for y in node[linked]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return met.groupBy("region", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    rows = stage(_described(docs, size), "signatures")
    nodes = stage(rows.where("n > 0").groupBy("fingerprint").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("signature").alias("signature"),
        F.count("*").alias("copies")), "nodes")
    pairs = stage(candidates(nodes.select("node", "n", "signature"), percent), "candidates")
    first = _strongest(pairs)
    links = stage(confirmed(first, docs, size, percent), "links")
    groups = star_components(links, "a", "b")
    rest = (pairs.join(first, ["a", "b"], "left_anti")
            .join(groups.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
            .join(groups.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    rest = stage(rest, "open-pairs")
    more = stage(confirmed(rest, docs, size, percent), "links")
    links = links.unionByName(more)
    groups = star_components(links, "a", "b")
    dense = stage(dense_rows(nodes.select("node", "n", "signature"), links, groups), "dense")
    if not dense.isEmpty():
        links = links.unionByName(stage(confirmed(stage(hub_pairs(dense, percent), "hub-pairs"), docs, size, percent), "links"))
        groups = star_components(links, "a", "b")
        links = links.unionByName(stage(open_links(dense, nodes, groups, docs, size, percent), "links"))
        groups = star_components(links, "a", "b")
    # only sets with copies or links change a label; salted, as one set may have a third of all rows
    labels = (nodes.join(groups, "node", "left").where("copies > 1 or root is not null")
              .select("fingerprint", F.coalesce("root", "node").alias("root"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    out = (rows.select("doc_id", "n", "fingerprint", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
           .join(labels, ["fingerprint", "salt"], "left")
           .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")))
    nulls = docs.where("doc_id is null").select(whole_text().alias("text"))

    def count(batches):
        for batch in batches:
            yield pd.DataFrame({"n_shingles": [len(s) for s in _sets(batch["text"], size)]})

    unnamed = nulls.mapInPandas(count, "n_shingles long").select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unnamed).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` (doc_id, text and any other columns) for each group: that of the
    smallest doc_id, null ids last. Rows are told apart by a number written with them, so null
    and repeated ids are rows like all others; of two rows with one id one stays."""
    key = "row"
    while key in [c.lower() for c in docs.columns]:
        key += "_"
    keyed = stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), size, percent)
    named = keyed.select(F.col(key).alias("at"), F.col("doc_id").alias("id"))
    first = (found.select(F.col("doc_id").alias("at"), "component_id").join(named, "at").groupBy("component_id")
             .agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")).alias("first"))
             .select(F.col("first.at").alias(key)))
    return keyed.join(first, key, "left_semi").select(docs.columns)
