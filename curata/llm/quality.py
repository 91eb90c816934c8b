"""Operator 6: quality by hashed word n-gram logistic regression.

Features: words (runs of letters and digits, or of other signs; case kept) and pairs of
neighbouring words, hashed to 2^20 slots; a pair of equal words has one slot of its own.
Values are log(1 + count), scaled by the vector's length with a constant that keeps short
texts near the prior; a bias is always on. The weights follow the regularised leader
(per-slot steps, L1 and L2 terms), which leaves a sparse model; a score is the sigmoid of a
sparse dot product.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, chosen by a hash of
the id) in one task; scoring maps over all whole texts and moves nothing.

Defined results: a null or empty text scores by the bias alone; labels other than 0 and 1
and labels without a document are ignored; without usable labels every score is 0.5;
repeated rows score each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import (SCANNED_BYTES, batched_bytes, combine, hash_words, labelled_sample, remainder,
                               whole_text)

BITS = 20
SAMPLE = 8_000
EPOCHS = 2
STEP = 3.0
L1 = 0.1
L2 = 0.5
SHORT = 10.0
BIAS = 1 << BITS
_SAME = 0  # the slot of a pair of equal words
_CLASSES = np.array([0 if b in (0x20, *range(9, 14)) else 1 if b >= 0x80 or chr(b).isalnum() else 2
                     for b in range(256)], np.uint8)


def _features(texts: list[bytes]):
    """(slots, values) of each text."""
    shift = np.uint64(64 - BITS)
    for few in batched_bytes(list(map(len, texts)), SCANNED_BYTES):
        for words in hash_words(texts[few], False, _CLASSES):
            pairs = (combine(words, 2) >> shift).astype(np.int64)
            pairs[words[1:] == words[:-1]] = _SAME
            slots, counts = np.unique(np.concatenate([(words >> shift).astype(np.int64), pairs]), return_counts=True)
            values = np.log1p(counts)
            values /= np.sqrt((values * values).sum() + SHORT)
            yield np.append(slots, BIAS), np.append(values, 1.0)


def _leader(z, n):
    w = (np.sign(z) * L1 - z) / ((1.0 + np.sqrt(n)) / STEP + L2)
    w[np.abs(z) <= L1] = 0.0
    return w


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero, after passes over the rows in the order given."""
    rows = [(s.astype(np.int32), v.astype(np.float32)) for s, v in _features(texts)]
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    for _ in range(epochs):
        for (slots, values), y in zip(rows, labels):
            zs, ns = z[slots], n[slots]
            w = _leader(zs, ns)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ values, -30, 30))) - y) * values
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / STEP * w
            n[slots] = ns + g * g
    w = _leader(z, n)
    slots = np.flatnonzero(w)
    return slots, w[slots]


def train(docs: DataFrame, labels: DataFrame, usable=None, bound: int = SAMPLE) -> tuple:
    """Fit on about ``bound`` labelled documents."""
    sample = labelled_sample(docs, labels, "quality", usable, bound)

    def run(batches):
        rows = list(batches)
        if rows:
            rows = pd.concat(rows).sort_values(["order", "text", "label"])
            slots, weights = fit([t.encode() for t in rows["text"]], rows["label"].tolist())
            yield pd.DataFrame({"slot": slots, "weight": weights})

    got = sample.repartition(1).mapInPandas(run, "slot long, weight double").toPandas()
    return got["slot"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        dense = np.zeros(BIAS + 1)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            logits = [float(dense[s] @ v) for s, v in _features([t.encode() for t in batch["text"]])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"],
                                "score": 1.0 / (1.0 + np.exp(-np.clip(np.array(logits), -30, 30)))})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
                       F.col("doc_id").isNull().alias("no_id"), whole_text().alias("text"))
    return (rows.mapInPandas(run, "doc_id long, no_id boolean, score double")
            .select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out ids."""
    model = train(docs, labels, remainder("doc_id", 4) != 2)
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
