"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's words give four kinds of features: words and word pairs in lower case, and the same of word shapes (runs of
capitals, small letters and digits, marks as they are, and whether a word repeats the one before). Each kind is a
distribution whose roots have length one, so a score does not depend on length as such. Labels come from at most
`SAMPLE` labelled documents; scoring is a sparse dot product with 2^18 broadcast weights.

Null texts count as empty and score the bias. Null labels are not learnt from. Without labels of both classes the score
is the share of label 1 seen, 0.5 without any. Rows that agree in id and text are learnt once, with each of their
labels once; labels of ids that no document has are not learnt. Every row is scored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import forget, kept

BITS = 18
#: Labelled documents that are learnt from at most: the first by a hash of their ids.
SAMPLE = 4000
EPOCHS = 4
#: Rates of the updates: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.4, 1.0, 1e-4, 1e-4
#: Words whose hashes a worker keeps, and their characters, at most.
KEPT, KEPT_CHARS = 300_000, 8_000_000
_RUNS = ((re.compile(r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "9"), (re.compile(r"[^\W\dA9_]+"), "a"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def _shape(word: str) -> str:
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word


class Words:
    """Hashes of words and of their shapes, kept for words met before."""

    def __init__(self):
        self.index, self.table, self.chars = {}, np.zeros((1 << 14, 2), np.uint64), 0

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > KEPT or self.chars > KEPT_CHARS:
            self.__init__()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(at < 0).tolist():
            w = words[i]
            k = self.index.setdefault(w, len(self.index))
            self.chars += len(w)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = zlib.crc32(w.lower().encode()), zlib.crc32(_shape(w).encode(), 7)
            at[i] = k
        found = self.table[at]
        return found[:, 0], found[:, 1]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h + np.uint64(kind * 0x1F123BB5)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    word, shape = known.look(words)
    again = np.zeros(len(words), np.uint64)
    again[1:] = word[1:] == word[:-1]
    shape = shape * np.uint64(2) + again
    slots, values = [], []
    for kind, h in enumerate((word, word[:-1] * np.uint64(31) + word[1:], shape, shape[:-1] * np.uint64(31) + shape[1:])):
        if len(h):
            at, n = np.unique(_slots(h, kind), return_counts=True)
            slots.append(at)
            values.append(np.sqrt(n / len(h)))
    return np.concatenate(slots), np.concatenate(values).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights; the last is the bias. Rows are (slots, values, 0 or 1)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    share = np.mean([y for *_, y in rows]) if rows else 0.5
    if share in (0.0, 1.0) or not rows:
        w = np.zeros_like(z)
        w[-1] = np.log((share + 1e-6) / (1 - share + 1e-6)) if rows else 0.0
        return w
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def score(text: str | None, weights: np.ndarray, known: Words) -> float:
    at, x = features(text, known)
    return float(1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -35, 35))))


def model(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most `sample` labelled documents, the first by a hash of their ids. labels: doc_id, label."""
    rows = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y in (0, 1)").distinct()
    texts = df.select(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    # what is learnt is chosen among ids and hashes that documents have, so that repeated rows add nothing to it
    rows = texts.select("i", "h").join(rows, "i").distinct().orderBy(F.xxhash64("i"), "i", "h", "y").limit(sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = Words()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                at, x = features(t.as_py(), known)
                yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([x.tobytes()]), pa.array([y.as_py()], pa.int32())], names=["at", "x", "y"])

    # `sample` rows of ids, hashes and labels, a bound that the data do not change
    chosen = texts.join(F.broadcast(rows), ["i", "h"]).groupBy("i", "h", "y").agg(F.first("t").alias("t")).select("t", "y")
    got = chosen.mapInArrow(featured, "at binary, x binary, y int").collect()
    got.sort(key=lambda r: (zlib.crc32(bytes(r.at)), bytes(r.at), r.y))  # the order of learning, however rows arrive
    return train([(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.x, np.float32), r.y) for r in got])


def scored(df: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """The score of df's texts, from 0 to 1: higher where label 1 is likelier."""
    sent = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf(T.DoubleType())
    def made(texts: pa.Array) -> pa.Array:
        known = kept("words", Words)
        return pa.array([score(t.as_py(), sent.value, known) for t in texts], pa.float64())

    return made(F.col(text))
