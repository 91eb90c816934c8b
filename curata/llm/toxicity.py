"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences and toxic when at least one sentence is: with sentence
scores s = sigmoid(bias + weights of the features present), the document's score is the
noisy-or 1 - prod(1 - s). Only documents carry labels; the gradient of their log loss
reaches each sentence in proportion to its score, so training finds the offending ones.
Updates follow the regularised leader with an L1 term, which leaves few features.

Features of a sentence: its words and the words' prefixes of 4, 5 and 6 bytes, lower-cased
and hashed to 2^22 slots. The model is fitted on a bounded sample of labelled rows
(``SAMPLE``, chosen by a hash of the id) in one task; scoring maps over all whole texts and
moves nothing. The L1 term shrinks with a smaller sample.

Defined results: null or empty text, or one without words, scores 0; labels other than 0
and 1 and labels without a document are ignored; without usable labels of both kinds every
score is 0; repeated rows score each; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import SCANNED_BYTES, batched_bytes, labelled_sample, remainder, scan_words, text_slices, whole_text

BITS = 22
SAMPLE = 8_000
EPOCHS = 8
STEP = 1.0
L1 = 6.0
PREFIXES = (4, 5, 6)
FIRST_BIAS = -7.0

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".!?\n"]] = True
#: letters, digits and all bytes of non-ASCII characters make words
_CLASSES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)], np.uint8)
_BEFORE_WORDS = re.compile(rb"[^0-9A-Za-z\x80-\xff]*")
_SENTENCE_END = re.compile(r"[.!?\n]")


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.slots] = self.weights
        return out


def _features(texts: list[bytes]):
    """For each text (slots, sentence) arrays, an entry per feature; sentences numbered by
    the breaks before them."""
    shift = np.uint64(64 - BITS)
    for few in batched_bytes(list(map(len, texts)), SCANNED_BYTES):
        for found in scan_words(texts[few], True, _CLASSES, _BREAKS, PREFIXES):
            words, sentence = found[0], found[1]
            slots = np.concatenate([(x >> shift).astype(np.int64) for x in [words, *found[2:]]])
            yield slots, sentence


def _present(slots: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once per sentence."""
    once = np.unique((sentence.astype(np.int64) << BITS) | slots)
    return once & ((1 << BITS) - 1), once >> BITS


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, step: float = STEP) -> Model:
    """Follow-the-regularised-leader over documents, in the order given."""
    bags = []
    for slots, sentence in _features(texts):
        if len(sentence):
            numbered = np.cumsum(np.diff(sentence, prepend=sentence[0]) > 0)
            slots, at = _present(slots, np.tile(numbered, 1 + len(PREFIXES)))
            bags.append((slots.astype(np.int32), at.astype(np.int32), int(numbered[-1]) + 1))
        else:
            bags.append(None)
    l1 = min(L1, max(0.5, len(bags) / 700))
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)

    def leader(zs, ns):
        w = (np.sign(zs) * l1 - zs) * step / (1.0 + np.sqrt(ns))
        w[np.abs(zs) <= l1] = 0.0
        return w

    bias, squared = FIRST_BIAS, 1.0
    for _ in range(epochs):
        for bag, y in zip(bags, labels):
            if bag is None:
                continue
            slots, at, count = bag
            own, inverse = np.unique(slots, return_inverse=True)
            zs, ns = z[own], n[own]
            w = leader(zs, ns)
            s = _sigmoid(np.bincount(at, w[inverse], count) + bias)
            p = float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum()))
            p = min(max(p, 1e-9), 1 - 1e-9)
            g = (p - y) / p * s
            gradient = np.bincount(inverse, g[at], len(own))
            z[own] = zs + gradient - (np.sqrt(ns + gradient ** 2) - np.sqrt(ns)) / step * w
            n[own] = ns + gradient ** 2
            squared += float(g.sum()) ** 2
            bias -= 0.1 * float(g.sum()) / squared ** 0.5
    w = leader(z, n)
    slots = np.flatnonzero(w)
    return Model(slots, w[slots].astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, usable=None, bound: int = SAMPLE) -> Model | None:
    """Fit on about ``bound`` labelled documents; None without labels of both kinds."""
    sample = labelled_sample(docs, labels, "toxic", usable, bound)

    def run(batches):
        rows = list(batches)
        if rows:
            rows = pd.concat(rows).sort_values(["order", "text", "label"])
            if rows["label"].nunique() == 2:
                model = fit([t.encode() for t in rows["text"]], rows["label"].tolist())
                yield pd.DataFrame({"slot": np.append(model.slots, -1),
                                    "weight": np.append(model.weights.astype(float), model.bias)})

    got = sample.repartition(1).mapInPandas(run, "slot long, weight double").toPandas()
    if not len(got):
        return None
    weights = got[got["slot"] >= 0]
    return Model(weights["slot"].to_numpy(), weights["weight"].to_numpy(np.float32),
                 float(got.loc[got["slot"] < 0, "weight"].iloc[0]))


def _sentence_scores(slots, sentence, dense, bias):
    """Scores of the sentences that hold a known feature, by number, and the number of
    sentences with a word."""
    count = int(np.count_nonzero(np.diff(sentence))) + 1 if len(sentence) else 0
    every = np.tile(sentence, 1 + len(PREFIXES))
    hit = np.flatnonzero(dense[slots])
    slots, at = _present(slots[hit], every[hit])
    numbers, inverse = np.unique(at, return_inverse=True)
    return numbers, _sigmoid(np.bincount(inverse, dense[slots], len(numbers)) + bias), count


def _rated(texts: list[str], model: Model, dense: np.ndarray):
    """(score, number of the sentence with the highest score, that score) of each text; the
    sentence is None where no sentence holds a known feature."""
    quiet = float(np.log1p(-_sigmoid(model.bias)))
    texts = [t.encode() for t in texts]
    for text, (slots, sentence) in zip(texts, _features(texts)):
        numbers, s, count = _sentence_scores(slots, sentence, dense, model.bias)
        rest = np.log1p(-np.minimum(s, 1 - 1e-12)).sum() + quiet * (count - len(numbers))
        if len(s):
            worst = int(np.argmax(s))
            head = _BEFORE_WORDS.match(text).group()  # numbers run on over texts scanned together
            first = len(head) - len(head.translate(None, b".!?\n"))
            found = (int(numbers[worst] - sentence[0]) + first, float(s[worst]))
        yield (float(-np.expm1(rest)) if count else 0.0, *(found if len(s) else (None, None)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, worst_sentence, worst_score) of every row of ``docs`` (doc_id, text).
    Sentences are numbered by the sentence ends before them; ties go to the first; null where
    no sentence holds a known feature."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("worst_sentence"),
                           F.lit(None).cast("double").alias("worst_score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        dense = model.dense()
        for batch, texts in text_slices(batches):
            score, sentence, worst = zip(*_rated(texts, model, dense))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(sentence, pa.int64()),
                 pa.array(worst, pa.float64())], ["doc_id", "score", "worst_sentence", "worst_score"])

    return rows.mapInArrow(run, "doc_id long, score double, worst_sentence long, worst_score double")


def passing(docs: DataFrame, model: Model | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) that score less than ``limit``. The
    verdict is taken on the row itself, whatever its id, and nothing is shuffled."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        dense = model.dense()
        for batch, texts in text_slices(batches):
            yield batch.filter(pa.array([s < limit for s, *_ in _rated(texts, model, dense)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, score, text): sentences that score ``least`` or more, numbered by
    the sentence ends before them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        dense = model.dense()
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                slots, sentence = next(iter(_features([text.encode()])))
                numbers, s, _ = _sentence_scores(slots, sentence, dense, model.bias)
                if (s >= least).any():
                    parts = _SENTENCE_END.split(text)
                    out += [(key, int(k), float(v), parts[int(k)].strip())
                            for k, v in zip(numbers, s) if v >= least]
            yield pd.DataFrame(out, columns=["doc_id", "sentence", "score", "text"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                   whole_text().alias("text"))
    return rows.mapInPandas(run, "doc_id long, sentence long, score double, text string")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never saw the held-out ids."""
    model = train(docs, labels, remainder("doc_id", 5) != 0)
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "worst_score")
