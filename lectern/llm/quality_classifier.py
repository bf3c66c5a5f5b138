"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are its words and word pairs, hashed to BUCKETS columns, with their shares as values. FTRL-proximal keeps most weights at zero; a score
is the sparse dot product of the text's columns with the weights.

Defined cases: a null or empty text has only the bias column, so its score is the bias's; repeated rows are
scored alike, each by itself; without labelled rows every score is that of weights 0, 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, map_rows, mixed, schema_of

BUCKETS = 1 << 20
#: Labelled documents that training sees at most (a bounded sample, drawn by a hash of the id).
SAMPLE = 6_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 1.0
#: Sum of a text's values.
SCALE = 20.0
THRESHOLD = 0.3

_PLAIN = bytes([*range(0x61, 0x7B), *range(0x80, 0x100)])
_OUTLINE = bytes.maketrans(bytes([*range(0x41, 0x5B), *range(0x30, 0x3A)]), b"A" * 26 + b"0" * 10)
_OTHER, _TWICE = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x7769636574776963)


class Grams:
    """Hashed columns of texts: words and word pairs, and the same of the texts' outlines, so that odd marks and
    capitals are learned apart from the words they are at. The outline drops lower-case letters and anything
    beyond ASCII; capitals become A and digits 0. A pair of equal words counts as one more word, TWICE."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Columns (1 or more each; with repeats) of one text."""
        text = text or b""
        words, outline = self.hashes.of(text.lower().split()), self.hashes.of(text.translate(_OUTLINE, _PLAIN).split()) ^ _OTHER
        grams = [words, outline]
        if len(words) > 1:
            grams += [mixed(words[:-1], words[1:]), np.full(int((words[1:] == words[:-1]).sum()), _TWICE)]
        if len(outline) > 1:
            grams.append(mixed(outline[:-1], outline[1:]))
        g = np.concatenate(grams)
        return ((g ^ (g >> np.uint64(33))) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def values(n: int) -> float:
    """What each occurrence of a column adds, of n in the text."""
    return SCALE / max(n, 1)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """FTRL-proximal weights for (columns, values, label) rows, a row at a time."""
    z, n, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS, np.float32)
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for k in order:
            cols, vals, y = rows[k]
            zc, nc = z[cols], n[cols]
            rate = (BETA + np.sqrt(nc)) / ALPHA + L2
            wc = np.where(np.abs(zc) > L1, -(zc - np.sign(zc) * L1) / rate, 0.0)
            p = 1 / (1 + np.exp(-np.clip(wc @ vals, -35, 35)))
            g = (p - y) * vals
            sigma = (np.sqrt(nc + g * g) - np.sqrt(nc)) / ALPHA
            z[cols] = zc + g - sigma * wc
            n[cols] = nc + g * g
    on = np.abs(z) > L1
    w[on] = (-(z[on] - np.sign(z[on]) * L1) / ((BETA + np.sqrt(n[on])) / ALPHA + L2)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` labelled documents of those where ``learn`` (a condition on doc_id)."""
    ids = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    chosen = ids.orderBy(F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string"))), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_label").cast("double").alias("label"))
    schema = schema_of("doc_id long, label double, cols binary")
    grams = Grams()

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "label": cols["label"], "cols": [grams(t).tobytes() for t in cols["text"]]}

    rows = map_rows(known.withColumn("doc_id", F.col("doc_id").cast("long")), run, schema).orderBy("doc_id", "cols").limit(sample).toPandas()
    got = []
    for raw, y in zip(rows["cols"], rows["label"], strict=True):
        c = np.frombuffer(raw, np.int32)
        own, n = np.unique(c, return_counts=True)
        got.append((np.concatenate([[0], own]), np.concatenate([[1.0], n * values(len(c))]), y))
    return train(got)


def score(docs: DataFrame, weights: np.ndarray, keys: list[str]) -> DataFrame:
    """``keys`` and score of each document. The weights are BUCKETS floats at most, sent once to each executor."""
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("score", T.DoubleType())])
    on = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((on.astype(np.int32), weights[on]))
    grams, held = Grams(), []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not held:
            w = np.zeros(BUCKETS, np.float32)
            w[sent.value[0]] = sent.value[1]
            held.append(w)
        w, out = held[0], []
        for t in cols["text"]:
            c = grams(t)
            out.append(1 / (1 + np.exp(-np.clip(float(w[0]) + float(w[c].sum(dtype=np.float64)) * values(len(c)), -35, 35))))
        return {k: cols[k] for k in keys} | {"score": out}

    return map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema)
