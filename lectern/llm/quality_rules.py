"""Quality rules: counts of a document, and gradient-boosted trees over statistics made of them.

``keep_documents`` judges every row of a table by its whole text. Defined cases: a null text has no words
and fails the base rule, as does an empty one; repeated rows are judged alike, each by itself; other
columns, whatever their names, pass through; an empty table gives an empty result; without labelled rows
the trees keep whatever the base rule keeps.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, WordHashes, map_rows, mixed, schema_of
from .trees import Forest, train

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Labelled documents that the trees are fitted on at most; the rest of the labels isn't needed for so few columns.
SAMPLE = 8_000
#: A document goes if the trees give quality less than this probability.
LEAST = 0.15

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see; the score may only fall as those marked -1 rise.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "letters": 0,
    "digits": 0, "capitals": 0, "ended_lines": 0, "words_a_line": 0, "punctuation": 0, "bars": -1, "top_word": -1,
}
_NOT_LETTERS = bytes(i for i in range(256) if not (i >= 128 or chr(i).isalpha()))
_CAPITALS, _DIGITS, _STOPS = bytes(range(65, 91)), b"0123456789", b".,;:!?"
_ENDED = re.compile(rb"[.!?:;\"')\]][ \t\r\x0b\x0c]*(?:\n|\Z)")


def repeated(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By text: words inside 8-word windows that are in the same text twice or more. hashes: of all texts' words, in a row."""
    n, ends = len(hashes), np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    if n < WINDOW:
        return np.zeros(len(lengths), np.int64)
    starts = np.arange(n - WINDOW + 1)
    starts = starts[starts + WINDOW <= ends[owner[starts].astype(np.int64)]]
    if not len(starts):
        return np.zeros(len(lengths), np.int64)
    windows = mixed(owner[starts], *(hashes[starts + k] for k in range(WINDOW)))
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts[twice], 1)
    np.add.at(step, starts[twice] + WINDOW, -1)
    return np.bincount(owner.astype(np.int64), step.cumsum()[:n] > 0, len(lengths)).astype(np.int64)


def statistics(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and FEATURES of each text."""
    counts, features = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    words = [(t or b"").split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    codes = hashes.of([x for w in words for x in w])
    again, at = repeated(codes, lengths), 0
    for i, t in enumerate(texts):
        t, n = t or b"", int(lengths[i])
        own, at = codes[at : at + n], at + n
        lines = [x for x in t.split(b"\n") if x.strip(WHITE)]
        symbols = len(t) - len(t.translate(None, SYMBOLS))
        inner = t.translate(None, WHITE)
        chars = len(inner) if inner.isascii() else len(inner.decode("utf-8", "replace"))
        counts[i] = n, chars, symbols, len(lines) - len(set(lines)), again[i]
        if n:
            size = max(len(inner), 1)
            distinct, many = np.unique(own, return_counts=True)
            share = lambda drop: (len(inner) - len(inner.translate(None, drop))) / size
            features[i] = (
                np.log1p(n), chars / n, symbols / n, counts[i, 3] / len(lines), again[i] / n, len(distinct) / n, 1 - share(_NOT_LETTERS),
                share(_DIGITS), share(_CAPITALS), len(_ENDED.findall(t)) / len(lines), np.log1p(n / len(lines)), share(_STOPS), t.count(b"|") / n, many.max() / n,
            )
    return counts, features


def measured(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of each document, with its counts and statistics."""
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("stats", T.ArrayType(T.DoubleType()))])
    hashes = WordHashes()

    def run(cols: dict[str, list]) -> dict[str, list]:
        counts, features = statistics(cols["text"], hashes)
        return {k: cols[k] for k in keys} | {c: counts[:, j] for j, c in enumerate(COUNTS)} | {"stats": list(features)}

    return map_rows(docs.select(*keys, "text"), run, schema)


def labelled_sample(labels: DataFrame, limit: int, salt: str) -> DataFrame:
    """(doc_id, label) of ``limit`` labelled ids at most, drawn by a hash of the id: a bounded table."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_label"))
    return ids.orderBy(F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), "doc_id").limit(limit).select(F.col("doc_id").alias("_id"), "_label")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees for labels.quality from at most ``sample`` labelled documents."""
    chosen = F.broadcast(labelled_sample(labels, sample, "rules:"))  # bounded by sample
    known = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_label").cast("int").alias("label"))
    got = measured(known, ["doc_id", "label"]).select("doc_id", "label", "stats").orderBy("doc_id", "stats").limit(2 * sample).toPandas()
    x = np.array(got["stats"].tolist(), float).reshape(len(got), len(FEATURES))
    return train(x, got["label"].to_numpy(float), np.array(list(FEATURES.values())))


def judged(docs: DataFrame, forest: Forest, keys: list[str], least: float = LEAST) -> DataFrame:
    """``keys``, counts, base_failed, quality (the trees' probability) and kept of each document."""
    schema = T.StructType([*(docs.schema[k] for k in keys), *schema_of(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean").fields])
    hashes = WordHashes()

    def run(cols: dict[str, list]) -> dict[str, list]:
        counts, features = statistics(cols["text"], hashes)
        failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
        quality = forest.score(features)
        out = {c: counts[:, j] for j, c in enumerate(COUNTS)}
        return {k: cols[k] for k in keys} | out | {"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= least)}

    return map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema)


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    # the columns go by number meanwhile, so that none clashes with what is measured
    numbered = docs.select(*(docs[c].alias("text" if c == "text" else f"_{i}") for i, c in enumerate(docs.columns)))
    forest = fit(docs, labels)
    marked = judged(numbered, forest, numbered.columns).where("kept")
    return marked.select(*(F.col("text" if c == "text" else f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
