"""Operator 2: packing of token sequences by swap-based local search.

A document's ids (and an end id) are cut into pieces of at most ``CAPACITY`` ids; only
longer documents are cut. Pieces are dealt by a hash of a row number into groups of about
``GROUP`` pieces, each packed by one task: best fit by descending length, then a local
search over the bins that are not full. The search moves a piece, exchanges one for one, or
exchanges two for one between two bins whenever that raises the sum of squared fills; free
room so gathers in few bins until they empty. A group loses less than one bin to the split,
about one in ten thousand, and its memory does not depend on the corpus.

Only (row, length) pairs move between machines; the ids never do. Defined results: null
text = empty text (one piece with the end id alone); repeated rows are packed each; null
document ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import stage, whole_text
from curata.llm.tokens import vocabulary_path, word_tokens

CAPACITY = 2048
GROUP = 16_384
PASSES = 12

_PIECES = "row long, doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"
_PLACED = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Bins of pieces of known lengths, with the indexes that the search needs."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.length = [int(x) for x in lengths]
        self.capacity = capacity
        self.held: list[list[int]] = []       # pieces by bin
        self.fill: list[int] = []
        self.home = [0] * len(self.length)    # bin by piece
        self.loose: dict[int, set[int]] = {}  # length -> pieces in bins that are not full
        self.seen = 0                         # bit n: a piece of length n is loose

    def best_fit(self) -> None:
        """Each piece, longest first, to the fullest bin that still takes it."""
        open_bins: dict[int, list[int]] = {}
        rooms = 0                             # bit r: a bin has room r
        for p in sorted(range(len(self.length)), key=lambda i: -self.length[i]):
            n = self.length[p]
            fitting = rooms >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                b = open_bins[room].pop()
                if not open_bins[room]:
                    rooms &= ~(1 << room)
            else:
                b, room = len(self.held), self.capacity
                self.held.append([])
                self.fill.append(0)
            self.held[b].append(p)
            self.fill[b] += n
            self.home[p] = b
            left = room - n
            if left:
                open_bins.setdefault(left, []).append(b)
                rooms |= 1 << left

    def _loosen(self, b: int) -> None:
        for p in self.held[b]:
            n = self.length[p]
            self.loose.setdefault(n, set()).add(p)
            self.seen |= 1 << n

    def _fasten(self, b: int) -> None:
        for p in self.held[b]:
            n = self.length[p]
            same = self.loose.get(n)
            if same and p in same:
                same.remove(p)
                if not same:
                    self.seen &= ~(1 << n)

    def _longest(self, most: int) -> int:
        """The longest loose length of at most ``most`` (0: none)."""
        return (self.seen & ((2 << most) - 1)).bit_length() - 1 if most > 0 else 0

    def _donor(self, n: int, a: int, gain: int) -> int | None:
        """A loose piece of length ``n`` whose bin is less full than ``a`` will be."""
        tried = 0
        for p in self.loose.get(n, ()):
            b = self.home[p]
            if b != a and self.fill[b] < self.fill[a] + gain:
                return p
            tried += 1
            if tried == 16:
                return None
        return None

    def _exchange(self, a: int, out: list[int], into: list[int]) -> None:
        b = self.home[into[0]]
        self._fasten(a)
        self._fasten(b)
        gain = sum(self.length[p] for p in into) - sum(self.length[p] for p in out)
        self.held[a] = [p for p in self.held[a] if p not in out] + into
        self.held[b] = [p for p in self.held[b] if p not in into] + out
        self.fill[a] += gain
        self.fill[b] -= gain
        for p in into:
            self.home[p] = a
        for p in out:
            self.home[p] = b
        for c in (a, b):
            if 0 < self.fill[c] < self.capacity:
                self._loosen(c)

    def _improve(self, a: int) -> bool:
        """The exchange that fills bin ``a`` most, if one raises the squared fills."""
        room = self.capacity - self.fill[a]
        best: tuple[int, list[int], list[int]] = (0, [], [])
        n = self._longest(room)                                   # a move
        if n and (p := self._donor(n, a, n)) is not None:
            best = (n, [], [p])
        own = sorted({self.length[p]: p for p in self.held[a]}.items())[:24]
        for size, q in own:                                       # one for one
            if best[0] == room:
                break
            n = self._longest(size + room)
            if n - size > best[0] and (p := self._donor(n, a, n - size)) is not None:
                best = (n - size, [q], [p])
        flat = sorted((self.length[p], p) for p in self.held[a])[:12]
        for i, (x, q) in enumerate(flat):                         # two of a for one
            if best[0] == room:
                break
            for y, r in flat[i + 1:]:
                n = self._longest(min(x + y + room, self.capacity))
                if n - x - y > best[0] and (p := self._donor(n, a, n - x - y)) is not None:
                    best = (n - x - y, [q, r], [p])
                    if best[0] == room:
                        break
        for size, q in own:                                       # one of a for two
            if best[0] == room:
                break
            n = self._longest(size + room)
            while n > best[0]:
                p = self._donor(n, a, max(n - size, 1))
                if p is not None:
                    b = self.home[p]
                    for other in self.held[b]:
                        gain = n + self.length[other] - size
                        if other != p and best[0] < gain <= room and self.fill[b] < self.fill[a] + gain:
                            best = (gain, [q], [p, other])
                    break
                n = self._longest(n - 1)
        if not best[0]:
            return False
        self._exchange(a, best[1], best[2])
        return True

    def search(self, passes: int = PASSES) -> None:
        for b, fill in enumerate(self.fill):
            if fill < self.capacity:
                self._loosen(b)
        for _ in range(passes):
            better = False
            for a in sorted(range(len(self.fill)), key=lambda b: -self.fill[b]):
                while 0 < self.fill[a] < self.capacity and self._improve(a):
                    better = True
            if not better:
                break


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, pieces in enumerate(x for x in bins.held if x):
        at = 0
        for p in pieces:
            where[p], offset[p] = b, at
            at += bins.length[p]
    return where, offset


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with a row number of its own."""
    def run(batches):
        encode, end = word_tokens(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, missing, text in zip(batch["doc_id"], batch["no_id"], batch["text"]):
                ids = encode(text) + end
                for i in range(0, len(ids), 4 * capacity):
                    part = ids[i:i + 4 * capacity]
                    rows.append((key, missing, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
                       F.col("doc_id").isNull().alias("no_id"), whole_text().alias("text"))
    pieces = rows.mapInPandas(run, _PIECES.removeprefix("row long, "))
    return pieces.withColumn("row", F.monotonically_increasing_id())


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                   group: int = GROUP) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and offset."""
    pieces = stage(cut_pieces(docs, vocabulary or vocabulary_path("word_bpe_49k.json"), 0, capacity), "pieces")
    groups = max(1, round(pieces.count() / group))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"]).reset_index(drop=True)
        where, offset = pack(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (np.int64(rows["deal"].iloc[0]) << 32) + where
        rows["offset"] = offset
        return rows[["doc_id", "no_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    placed = (pieces.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(groups)))
              .groupBy("deal").applyInPandas(place, _PLACED))
    return placed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
