"""Operator 13: removal of repeated byte strings by a sparse, hash-compared suffix sort.

A string of ``LENGTH`` bytes is removed where it also starts earlier. Every such string
(a window) is assigned to one of its own positions, its anchor: the leftmost smallest hash
among its runs of ``GRAM`` bytes. Equal windows have their anchor at the same place, so only
suffixes that begin with the same anchor run need comparing, and only about one position in
thirty is an anchor. Whole texts are written once with their anchors, packed in chunks
(bucketed by chunk number, so that no later step shuffles them); each step sends questions about anchors to
parts chosen by a hash and brings the answers back to the chunk:

1. ``REPEATED``: is the anchor's run found elsewhere at all? (8 bytes an anchor.)
2. ``FIRST``: of those, is this the first place of its whole context (the bytes of all its
   windows)? A later one is covered as a whole. Contexts are compared by 128-bit BLAKE2b.
3. ``SEVERAL``: among the first ones, do different contexts share the run, and how many?
4. ``SORT``: those contexts travel with their bytes to the part of their run. There the
   windows of a run are suffix-sorted by a mergesort whose comparisons find the common
   extension by binary search over polynomial prefix hashes; the sorted order is verified
   on the bytes themselves (a collision falls back to comparing bytes). Of neighbours with
   ``LENGTH`` common bytes, all but the earliest are covered.
5. ``CROWD``: a run with more than ``CROWDED`` different contexts (an edge of a passage that
   very many documents share) is not sorted in one part: its windows are asked for their
   first place one by one, as in step 2, spread over all parts.

A chunk sends a run or a context once, so a passage that a third of all documents hold is
one entry a chunk. Parts follow the number of bytes (``PART_BYTES``), so what a task holds
does not grow with the data. Covered bytes are taken together per document.

Defined results: null text = empty text, nothing to remove; texts shorter than ``LENGTH``
bytes keep all; rows with one ``doc_id`` count as one document, in which only a smaller
start is earlier, so repeated rows are treated alike; null ids count as one document after
all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.chunks import CHUNK_BYTES, bucketed, by_part, pack, part_count, unpack, with_answers
from curata.llm.common import _BYTE, batched_bytes, mix, stage, whole_text

LENGTH = 100                    # bytes of a repeated string
GRAM = 40                       # bytes that an anchor is chosen by
REACH = LENGTH - GRAM + 1       # places of a run within a window
CROWDED = 4096                  # contexts of one run that are sorted in one part
_SCAN = 1 << 20                 # windows looked at in one numpy pass
_SORT_WINDOWS = 1 << 18         # windows sorted in one numpy pass
_LAST = (1 << 63) - 1           # order of null ids
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U64 = np.uint64
_LOW = _U64(0xFFFFFFFF)

REPEATED, FIRST, SEVERAL, SORT, CROWD = 1, 2, 3, 4, 5
_QUESTIONS = ("chunk long, part int, key binary, more binary, number binary, doc binary, pos binary, "
              "left binary, windows binary, bytes binary")
_PACKED = ("keys array<string>, sizes binary, bytes long, blob binary, runs binary, steps binary, "
           "before binary, windows binary")
_POWERS: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse, modulo 2^64."""
    if n > len(_POWERS[0]):
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, _U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=_U64)
    return _POWERS


class Extensions:
    """Common extensions of suffixes of one buffer, by polynomial prefix hashes."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        power, self.inverse = _powers(len(buf) + 1)
        self.prefix = np.zeros(len(buf) + 1, _U64)
        np.cumsum(_BYTE[buf] * power[:len(buf)], out=self.prefix[1:])

    def hashes(self, at: np.ndarray, n) -> np.ndarray:
        """Hashes of the ``n`` bytes from each place; equal strings have equal hashes."""
        return (self.prefix[at + n] - self.prefix[at]) * self.inverse[at]

    def runs(self, n: int) -> np.ndarray:
        """Mixed hashes of the ``n`` bytes from every place that has so many."""
        return mix((self.prefix[n:] - self.prefix[:-n]) * self.inverse[:len(self.prefix) - n])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to ``LENGTH``, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH, np.int64)
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes(x, middle) == self.hashes(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def order(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the window at x sorts before, with or after that at y."""
        n = self.common(x, y)
        at = np.minimum(n, LENGTH - 1)
        a, b = self.buf[x + at].astype(np.int16), self.buf[y + at].astype(np.int16)
        return np.where(n == LENGTH, 0, np.sign(a - b))


def merge_sort(ext: Extensions, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """A permutation that sorts the windows at ``at`` within each segment (``segment`` does
    not decrease): bottom-up merges of all segments at once; each element finds its rank in
    the run beside its own by binary search."""
    order = np.arange(len(at))
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(at) else order
    sizes = np.diff(np.append(starts, len(at)))
    first, last = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    width = 1
    while len(sizes) and width < sizes.max():
        place = np.flatnonzero(last - first > width)
        local = place - first[place]
        run = local // width
        begin = np.minimum(first[place] + (run ^ 1) * width, last[place])
        low, high = begin.copy(), np.minimum(begin + width, last[place])
        right = (run & 1).astype(bool)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            found = ext.order(at[order[middle]], at[order[place[open_]]])
            before = (found < 0) | (right[open_] & (found == 0))
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        target = first[place] + (run & ~1) * width + (local - run * width) + (low - begin)
        merged = order.copy()
        merged[target] = order[place]
        order, width = merged, 2 * width
    return order


def sorted_windows(ext: Extensions, at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the windows sorted within their segments, and for each in that order
    whether it equals the one before; checked on the bytes."""
    order = merge_sort(ext, at, segment)
    same = np.zeros(len(at), bool)
    wrong = []
    for lo in range(1, len(at), 1 << 14):
        i = np.arange(lo, min(lo + (1 << 14), len(at)))
        a = ext.buf[at[order[i - 1]][:, None] + np.arange(LENGTH)]
        b = ext.buf[at[order[i]][:, None] + np.arange(LENGTH)]
        differ = a != b
        k = differ.argmax(1)
        equal, rows = ~differ.any(1), np.arange(len(i))
        inside = segment[i] == segment[i - 1]
        same[i] = equal & inside
        wrong.extend(segment[i[inside & ~equal & (a[rows, k] > b[rows, k])]].tolist())
    for s in set(wrong):  # two different strings with one hash: sort their segment by its bytes
        own = np.flatnonzero(segment == s)
        text = [ext.buf[p:p + LENGTH].tobytes() for p in at[own].tolist()]
        ranked = sorted(range(len(own)), key=text.__getitem__)
        order[own] = own[ranked]
        same[own] = [k > 0 and text[ranked[k]] == text[ranked[k - 1]] for k in range(len(own))]
    return order, same


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, run hash): every anchor of the documents that end at ``ends``
    and the first and last window that it is the anchor of."""
    starts = np.append(0, ends[:-1]).astype(np.int64)
    whole = np.ones(len(buf) + 1, np.int8)
    cut = np.zeros(len(buf) + 1, np.int64)
    np.add.at(cut, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(cut, ends, -1)
    whole[np.cumsum(cut) > 0] = 0
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, len(buf) - LENGTH + 1), _SCAN):
        hi = min(lo + _SCAN, len(buf) - LENGTH + 1)
        runs = Extensions(buf[lo:hi + LENGTH - 1]).runs(GRAM)
        least = (runs & ~_LOW) | np.arange(len(runs), dtype=_U64)
        width = 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:hi - lo], least[REACH - width:REACH - width + hi - lo])
        window = np.flatnonzero(whole[lo:hi])
        if not len(window):
            continue
        own = (least[window] & _LOW).astype(np.int64)
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        until = np.append(edge[1:], len(own)) - 1
        one = [own[edge] + lo, window[edge] + lo, window[until] + lo, runs[own[edge]]]
        if found and found[-1][0][-1] == one[0][0]:  # an anchor seen from both passes
            found[-1][2][-1] = one[2][0]
            one = [x[1:] for x in one]
        if len(one[0]):
            found.append(one)
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _ordered_first(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, kept): is there an equal key at a smaller (doc, pos)? and the entries that
    are the only one, or one of the first ones, of their key."""
    order = np.lexsort((pos, doc, *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][group] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] > doc[head]) | (pos[order] > pos[head])
    return later, np.sort(order[new])


class Chunk:
    """The anchors of a chunk of documents and what is known of them so far."""

    def __init__(self, row):
        import zstandard
        self.chunk = int(row.chunk)
        self.keys = list(row.keys)
        self.sizes = unpack(row.sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        blob = zstandard.ZstdDecompressor().decompress(row.blob)
        self.data, self.buf = blob, np.frombuffer(blob, np.uint8)
        self.anchor = np.cumsum(unpack(row.steps, np.uint32).astype(np.int64))
        self.first = self.anchor - unpack(row.before, np.uint8)
        self.last = self.first + unpack(row.windows, np.uint8) - 1
        self.run = unpack(row.runs, _U64)
        document = np.searchsorted(self.ends, self.anchor, "right")
        known = np.array([_LAST if k is None else int(k) for k in self.keys], np.int64)
        self.doc = known[document]
        self.pos = (self.anchor - (self.ends - self.sizes)[document]).astype(np.uint32)
        self.active = np.arange(len(self.anchor))     # anchors that the next step asks about
        self.crowd = np.zeros(0, np.int64)
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []

    def _cover(self, which: np.ndarray) -> None:
        self.spans.append((self.first[which], self.last[which] + LENGTH))

    def ask(self, step: int) -> dict[str, np.ndarray | list]:
        """The entries to send; remembers which anchors or windows they stand for."""
        if step in (REPEATED, SEVERAL):
            self.asked, self.inverse, counts = np.unique(
                self.run[self.active], return_inverse=True, return_counts=True)
            return {"key": self.asked, "number": counts.astype(np.uint32)}
        if step == FIRST:
            digests = np.frombuffer(b"".join(
                blake2b(self.data[f:l + LENGTH], digest_size=16, salt=a.to_bytes(8, "little")).digest()
                for f, l, a in zip(self.first[self.active].tolist(), self.last[self.active].tolist(),
                                   (self.anchor - self.first)[self.active].tolist())), _U64).reshape(-1, 2)
            keys = [digests[:, 0], digests[:, 1]]
            later, self.asked = _ordered_first(keys, self.doc[self.active], self.pos[self.active])
            self._cover(self.active[later])
            own = self.active[self.asked]
            twins = np.setdiff1d(np.flatnonzero(~later), self.asked)  # equal starts of rows with one id
            self.asked = np.sort(np.concatenate([self.asked, twins]))
            own = self.active[self.asked]
            return {"key": keys[0][self.asked], "more": keys[1][self.asked], "doc": self.doc[own], "pos": self.pos[own]}
        if step == SORT:
            own = self.asked = self.active
            return {"key": self.run[own], "doc": self.doc[own], "pos": self.pos[own],
                    "left": (self.anchor - self.first)[own].astype(np.uint8),
                    "windows": (self.last - self.first + 1)[own].astype(np.uint8),
                    "bytes": [self.data[f:l + LENGTH] for f, l in zip(self.first[own].tolist(), self.last[own].tolist())]}
        count = (self.last - self.first + 1)[self.crowd]
        entry = np.repeat(self.crowd, count)
        self.window = self.first[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        digests = np.frombuffer(b"".join(blake2b(self.data[p:p + LENGTH], digest_size=16).digest()
                                         for p in self.window.tolist()), _U64).reshape(-1, 2)
        pos = (self.pos[entry] - (self.anchor[entry] - self.window)).astype(np.uint32)
        keys = [digests[:, 0], digests[:, 1]]
        later, _ = _ordered_first(keys, self.doc[entry], pos)
        self.spans.append((self.window[later], self.window[later] + LENGTH))
        self.asked = np.flatnonzero(~later)
        return {"key": keys[0][self.asked], "more": keys[1][self.asked], "doc": self.doc[entry][self.asked],
                "pos": pos[self.asked]}

    def learn(self, step: int, answer: np.ndarray) -> None:
        """Take the answers, in the order of the entries asked."""
        if step == REPEATED:
            self.active = self.active[answer[self.inverse] > 1]
        elif step == FIRST:
            later = answer > 0
            self._cover(self.active[self.asked[later]])
            self.active = self.active[self.asked[~later]]
        elif step == SEVERAL:
            kind = answer[self.inverse]
            self.crowd = self.active[kind > 2]
            self.active = self.active[kind == 2]
        elif step == SORT:
            offsets = np.arange(REACH, dtype=_U64)
            for lo in range(0, len(answer), 1 << 14):
                entry, offset = np.nonzero((answer[lo:lo + (1 << 14), None] >> offsets) & _U64(1))
                at = self.anchor[self.asked[lo + entry]] - offset
                self.spans.append((at, at + LENGTH))
        else:
            at = self.window[self.asked[answer > 0]]
            self.spans.append((at, at + LENGTH))

    def replay(self, answers, until: int, parts: int) -> None:
        """Go through the steps before ``until`` with the answers that came back."""
        held: dict[int, dict[int, bytes]] = {}
        for a in answers if answers is not None else []:
            held.setdefault(int(a["step"]), {})[int(a["part"])] = a["answer"]
        for step in range(REPEATED, until):
            key = self.ask(step)["key"]
            answer = np.zeros(len(key), _U64)
            for part, own in by_part(key, parts):
                answer[own] = unpack(held[step][part], _U64 if step == SORT else np.uint8)
            self.learn(step, answer)

    def removed(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal removed runs of the chunk."""
        starts = np.concatenate([s for s, _ in self.spans] or [np.zeros(0, np.int64)])
        ends = np.concatenate([e for _, e in self.spans] or [np.zeros(0, np.int64)])
        change = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)
        gone = np.cumsum(change)[:-1] > 0
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        if len(gone):
            edge[0], edge[-1] = True, True
        edge[self.ends] = True
        cuts = np.flatnonzero(edge)
        pieces = gone[cuts[:-1]] if len(cuts) > 1 else np.zeros(0, bool)
        return cuts[:-1][pieces], cuts[1:][pieces]


def _sort_answer(rows: list) -> list[np.ndarray]:
    """For each context a mask: bit o is set where the window that starts o bytes before the
    anchor also starts earlier. Contexts of one run are compared by the suffix sort."""
    sizes = [len(unpack(r.key, _U64)) for r in rows]
    join = lambda name, t: np.concatenate([unpack(getattr(r, name), t) for r in rows])
    run, doc, pos = join("key", _U64), join("doc", np.int64), join("pos", np.uint32)
    left, windows = join("left", np.uint8).astype(np.int64), join("windows", np.uint8).astype(np.int64)
    import zstandard
    data = b"".join(zstandard.ZstdDecompressor().decompress(r.bytes) for r in rows)
    begin = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
    buf = np.frombuffer(data, np.uint8)
    by_time = np.lexsort((pos, doc))
    time = np.empty(len(by_time), np.int64)
    changed = (np.diff(doc[by_time]) != 0) | (np.diff(pos[by_time].astype(np.int64)) != 0)
    time[by_time] = np.append(0, np.cumsum(changed))
    mask = np.zeros(len(run), _U64)
    by_run = np.argsort(run, kind="stable")
    heads = np.flatnonzero(np.append(True, run[by_run][1:] != run[by_run][:-1]))
    groups = np.split(by_run, heads[1:])
    for some in batched_bytes([int(windows[g].sum()) for g in groups], _SORT_WINDOWS):
        own = np.concatenate(groups[some])
        group = np.repeat(np.arange(len(groups[some])), [len(g) for g in groups[some]])
        count = windows[own]
        entry = np.repeat(own, count)
        step = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        offset = left[entry] - step
        # a compact copy of these contexts, so that the hashes follow the batch
        lengths = count + LENGTH - 1
        base = np.cumsum(lengths) - lengths
        text = buf[np.repeat(begin[own] - base, lengths) + np.arange(int(lengths.sum()))]
        at = np.repeat(base, count) + step
        segment = np.repeat(group, count) * REACH + offset
        by_segment = np.argsort(segment, kind="stable")
        segment = segment[by_segment]
        crowd = np.bincount(np.cumsum(np.append(False, segment[1:] != segment[:-1])))
        keep = np.repeat(crowd > 1, crowd)
        by_segment, segment = by_segment[keep], segment[keep]
        if not len(segment):
            continue
        order, same = sorted_windows(Extensions(text), at[by_segment], segment)
        equal = np.cumsum(~same) - 1
        when = time[entry[by_segment[order]]]
        earliest = np.minimum.reduceat(when, np.flatnonzero(~same))[equal]
        hit = by_segment[order[when > earliest]]
        np.bitwise_or.at(mask, entry[hit], _U64(1) << offset[hit].astype(_U64))
    return np.split(mask, np.cumsum(sizes)[:-1])


def _answers(step: int, rows: list, crowded: int) -> list[np.ndarray]:
    if step == SORT:
        return _sort_answer(rows)
    sizes = [len(unpack(r.key, _U64)) for r in rows]
    key = np.concatenate([unpack(r.key, _U64) for r in rows])
    if step in (REPEATED, SEVERAL):
        number = np.concatenate([unpack(r.number, np.uint32) for r in rows])
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        total = np.add.reduceat(number[order].astype(np.int64), heads)
        answer = np.empty(len(key), np.uint8)
        answer[order] = np.repeat(1 + (total > 1) + (total > crowded), np.diff(np.append(heads, len(key))))
    else:
        more = np.concatenate([unpack(r.more, _U64) for r in rows])
        doc = np.concatenate([unpack(r.doc, np.int64) for r in rows])
        pos = np.concatenate([unpack(r.pos, np.uint32) for r in rows])
        answer = _ordered_first([key, more], doc, pos)[0].astype(np.uint8)
    return np.split(answer, np.cumsum(sizes)[:-1])


def _chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, keys, sizes, bytes, blob and the anchors): whole texts packed, written in
    buckets of ``chunk``."""
    def run(batches):
        import zstandard
        keys, texts, held = [], [], 0

        def row():
            sizes, data = np.array([len(t) for t in texts], np.int64), b"".join(texts)
            at, first, last, runs = anchors(np.frombuffer(data, np.uint8), np.cumsum(sizes))
            return pd.DataFrame({
                "keys": [keys], "sizes": [pack(sizes)], "bytes": [len(data)],
                "blob": [zstandard.ZstdCompressor(level=3).compress(data)], "runs": [pack(runs)],
                "steps": [pack(np.diff(at, prepend=0).astype(np.uint32))],
                "before": [pack((at - first).astype(np.uint8))],
                "windows": [pack((last - first + 1).astype(np.uint8))]})

        for batch in batches:
            for key, text in zip(batch["key"], batch["data"]):
                if keys and held + len(text) > chunk_bytes:
                    yield row()
                    keys, texts, held = [], [], 0
                keys.append(key)
                texts.append(text)
                held += len(text)
        if keys:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("key"),
                       whole_text().cast("binary").alias("data"))
    return bucketed(rows.mapInPandas(run, _PACKED), "suffix-chunks")


def _exchange(chunks: DataFrame, answers: DataFrame | None, step: int, parts: int, crowded: int) -> DataFrame:
    """(chunk, step, part, answer): one step's questions, answered and written."""
    def ask(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                chunk = Chunk(row)
                chunk.replay(getattr(row, "answers", None), step, parts)
                sent = chunk.ask(step)
                out = []
                for part, own in by_part(sent["key"], parts):
                    entry = {"chunk": chunk.chunk, "part": part}
                    for name, values in sent.items():
                        entry[name] = (_packed_bytes([values[i] for i in own.tolist()]) if name == "bytes"
                                       else pack(values[own]))
                    out.append(entry)
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _QUESTIONS.split(", ")])

    def answer(batches):
        rows = [r for batch in batches for r in batch.itertuples(index=False)]
        if rows:
            found = _answers(step, rows, crowded)
            yield pd.DataFrame({"chunk": [r.chunk for r in rows], "step": step, "part": [r.part for r in rows],
                                "answer": [pack(x) for x in found]})

    asked = with_answers(chunks, answers).mapInPandas(ask, _QUESTIONS)
    got = asked.repartition(parts, "part").mapInPandas(answer, "chunk long, step int, part int, answer binary")
    return stage(got, f"suffix-answers-{step}")


def _packed_bytes(pieces: list[bytes]) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=3).compress(b"".join(pieces))


def remove_repeats(docs: DataFrame, crowded: int = CROWDED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,length>>, kept binary) of every row of
    ``docs`` (doc_id, text): the text's bytes without the repeated ones."""
    chunks = _chunked(docs, chunk_bytes)
    parts = part_count(chunks)
    answers = None
    for step in (REPEATED, FIRST, SEVERAL, SORT, CROWD):
        new = _exchange(chunks, answers, step, parts, crowded)
        answers = new if answers is None else answers.unionAll(new)

    def finish(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                chunk = Chunk(row)
                chunk.replay(row.answers, CROWD + 1, parts)
                starts, ends = chunk.removed()
                heads = chunk.ends - chunk.sizes
                lo, hi = np.searchsorted(starts, heads), np.searchsorted(starts, chunk.ends)
                for some in batched_bytes(chunk.sizes.tolist(), 1 << 20):
                    out = []
                    for i in range(some.start, some.stop):
                        own = [(a, b) for a, b in zip(starts[lo[i]:hi[i]].tolist(), ends[lo[i]:hi[i]].tolist())]
                        at, kept = int(heads[i]), []
                        for a, b in own:
                            kept.append(chunk.data[at:a])
                            at = b
                        kept.append(chunk.data[at:int(chunk.ends[i])])
                        out.append({"key": chunk.keys[i], "n_bytes": int(chunk.sizes[i]), "kept": b"".join(kept),
                                    "spans": [{"start": a - int(heads[i]), "length": b - a} for a, b in own]})
                    yield pd.DataFrame(out)

    done = with_answers(chunks, answers).mapInPandas(
        finish, "key string, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
    return done.select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "spans", "kept")


def digests(docs: DataFrame, crowded: int = CROWDED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return remove_repeats(docs, crowded, chunk_bytes).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
