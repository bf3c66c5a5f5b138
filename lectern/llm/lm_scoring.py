"""LM scoring: a log-bilinear neural model, trained by noise-contrastive estimation on all training documents.

The model. Words fall into classes: the most frequent words, as many as the square root of the number of distinct ones but
no more than HEAD, are classes of their own, all others share a
class with the words that end in like letters (a hash of the last three bytes). Two classes of context predict a
vector, r1 C1 + r2 C2; a class scores by its dot product with that vector plus a bias. A word of a shared class
then has its share of the class by add-one counts. Scores are normalised exactly: with two context positions,
exp(A1[w1] + A2[w2] + b) summed over classes for all contexts at once is one matrix product, E1 diag(e^b) E2^T.

Work on Spark. Counts of every training word are a distributed aggregate (keyed by a 64-bit name of the word).
Words above a count that at most LISTED words reach are sent to all tasks (a bounded table); the counts of the
others are joined to the documents' remaining words, by a shuffle of those words only. Training goes in ROUNDS over
disjoint parts of all the training documents: shards of a part take NCE steps in numpy from the same start, and their
parameters are averaged in an aggregate by parameter row. Shards are cut by hashes, so scores don't depend on files or tasks.

Defined cases: null or empty text: only the end token; any length of text; rows are scored by themselves, so
repeated rows alike; a null id is in the training part; no training rows: N = V = 0, every word is unknown.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, map_rows, schema_of, stored

#: Most words that are classes of their own: the normaliser has a number for each pair of classes (26 MB at 2561).
HEAD = 2_047
ENDINGS = 512
#: Most words whose counts are sent to every task (16 bytes each).
LISTED = 500_000
WIDTH = 16
ROUNDS = 2
#: Tokens that a shard of a round has, about; and what parameters are multiplied by, so that their sums are exact.
SHARD_TOKENS = 1_000_000
FIXED = float(1 << 32)
BATCH, NOISE, RATE = 4_096, 48, 0.05
#: Distinct words that a counting task holds before it passes their counts on.
HELD_WORDS = 400_000
END = b"\n"

# classes: 0 stands before the text, 1 is the end, then endings, then head words
FIRST_ENDING, FIRST_WORD = 2, 2 + ENDINGS


#: A token's name: 55 bits of its hash, and its ending in the lowest bits.
_ENDING_BITS = ENDINGS - 1
_WORD_BITS = (1 << 64) - ENDINGS


def name_of(word: bytes) -> int:
    """The token's name as a signed number. Two words of one name would count as one: of 10 million, a pair by chance in 700."""
    h = (xxhash.xxh3_64_intdigest(word) & _WORD_BITS) | (zlib.crc32(word[-3:]) & _ENDING_BITS)
    return h - (1 << 64) if h >> 63 else h


END_NAME = name_of(END)


def words_of(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of all texts in a row, each text's end included; and the number of tokens of each."""
    words, lengths = [], []
    for t in texts:
        w = (t or b"").lower().split()
        words += w
        words.append(END)
        lengths.append(len(w) + 1)
    return words, np.array(lengths, np.int64)


class Codes(dict):
    """bytes word -> a number by ``make`` (of the word), kept for repeated words up to CACHE_WORDS."""

    def __init__(self, make: Callable[[bytes], int]) -> None:
        self.make = make

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        c = self[word] = self.make(word)
        return c

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): each distinct token's name and count over the rows of ``docs``."""
    schema = schema_of("h long, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def added() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name_of(w) for w in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["h", "c"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                held.update(words_of(b.column(0).slice(at, 256).cast(pa.binary()).to_pylist())[0])
                if len(held) >= HELD_WORDS:
                    yield added()
                    held.clear()
        if held:
            yield added()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return rows.groupBy("h").agg(F.sum("c").alias("c"))


class Lexicon:
    """What every task gets to know of the counts: at most LISTED words, the classes' totals, N and V."""

    def __init__(self, counts: DataFrame) -> None:
        bins = {r.bin: r.n for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count("*").alias("n")).collect()}  # a few hundred at most
        many, least = 0, None
        for k in sorted(bins, reverse=True):
            if (many := many + bins[k]) > LISTED:
                break
            least = k
        listed = counts.where(F.floor(F.log2("c") * 8) >= least) if least is not None else counts.limit(0)
        got = listed.select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
        h, c = got["h"].to_numpy(np.int64), got["c"].to_numpy(np.int64)
        e = h & _ENDING_BITS
        per = counts.groupBy(F.col("h").bitwiseAND(F.lit(_ENDING_BITS)).alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
        total, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
        total[per["ending"].to_numpy(np.int64)], distinct[per["ending"].to_numpy(np.int64)] = per["c"], per["v"]
        self.n, self.v = int(total.sum()), int(distinct.sum())
        words = np.flatnonzero(h != END_NAME)[: min(HEAD, math.isqrt(self.v))]
        kind = FIRST_ENDING + e
        kind[words] = FIRST_WORD + np.arange(len(words))
        kind[h == END_NAME] = 1
        own = (kind == 1) | (kind >= FIRST_WORD)
        np.subtract.at(total, e[own], c[own])
        np.subtract.at(distinct, e[own], 1)
        self.unigram = np.zeros(FIRST_WORD + len(words))
        self.unigram[kind[own]] = c[own]
        self.unigram[FIRST_ENDING:FIRST_WORD] = total
        #: log10 of what the add-one counts of a shared class's words, and of one unknown word, add up to
        self.log_total = np.log10(total + distinct + 1)
        order = np.argsort(h)
        self.h, self.known = h[order], len(h)
        # what stands for a word: its place in the list, or beyond it that of its ending
        self.kind = np.concatenate([kind[order], FIRST_ENDING + np.arange(ENDINGS)]).astype(np.int32)
        self.log_c = np.concatenate([np.log10(c[order] + 1.0), np.zeros(ENDINGS)])
        shared = (self.kind >= FIRST_ENDING) & (self.kind < FIRST_WORD)
        self.share = np.where(shared, self.log_c - self.log_total[np.clip(self.kind - FIRST_ENDING, 0, ENDINGS - 1)], 0.0)

    def place(self, word: bytes) -> int:
        """The word's place in the list, or beyond it that of its ending."""
        name = name_of(word)
        at = int(np.searchsorted(self.h, name))
        return at if at < self.known and self.h[at] == name else self.known + (name & _ENDING_BITS)

    def kind_of(self, word: bytes) -> int:
        return int(self.kind[self.place(word)])


def contexts(kind: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before each; 0 before a text's start."""
    one, two = np.zeros_like(kind), np.zeros_like(kind)
    one[1:], two[2:] = kind[:-1], kind[:-2]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    one[starts] = 0
    two[starts] = 0
    second = starts[lengths > 1] + 1
    two[second] = 0
    return one, two


def start_model(unigram: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    p = (unigram + 0.5) / (unigram + 0.5).sum()
    r = rng.normal(0, 0.3, (len(p), WIDTH)).astype(np.float32)
    q = np.zeros((len(p), WIDTH), np.float32)  # at first, the classes' own frequencies
    return {"r": r, "q": np.column_stack([q, np.log(p)]).astype(np.float32), "c1": np.eye(WIDTH, dtype=np.float32), "c2": 0.5 * np.eye(WIDTH, dtype=np.float32)}


class Trainer:
    """NCE with AdaGrad; the noise words of a batch are shared by all its positions, so that scores are matrix products."""

    def __init__(self, model: dict[str, np.ndarray], unigram: np.ndarray) -> None:
        self.m = {k: v.copy() for k, v in model.items()}
        self.g = {k: np.full(v.shape, 1e-6, np.float32) for k, v in model.items()}
        p = (unigram + 0.5) / (unigram + 0.5).sum()
        self.noise, self.log_kq = p.cumsum(), np.log(NOISE * p).astype(np.float32)
        self.rng = np.random.default_rng(11)

    def move(self, name: str, grad: np.ndarray) -> None:
        self.g[name] += grad * grad
        self.m[name] -= RATE * grad / np.sqrt(self.g[name])

    def summed(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of the values' rows by class."""
        out = np.empty((len(self.noise), values.shape[1]), np.float32)
        for j in range(values.shape[1]):
            out[:, j] = np.bincount(rows, values[:, j], len(out))
        return out

    def step(self, one: np.ndarray, two: np.ndarray, kind: np.ndarray) -> None:
        m, n = self.m, len(kind)
        r1, r2 = m["r"][one], m["r"][two]
        hat = np.column_stack([r1 @ m["c1"] + r2 @ m["c2"], np.ones(n, np.float32)])
        draw = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE)), len(self.noise) - 1)
        qw, qn = m["q"][kind], m["q"][draw]
        true = np.einsum("ij,ij->i", hat, qw) - self.log_kq[kind]
        false = hat @ qn.T - self.log_kq[draw]
        d_true = (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1).astype(np.float32)[:, None] / n
        d_false = 1 / (1 + np.exp(-np.clip(false, -30, 30))) / n
        d_hat = (d_true * qw + d_false @ qn)[:, :WIDTH]
        d_q = self.summed(kind, d_true * hat)
        np.add.at(d_q, draw, d_false.T @ hat)
        d_r = self.summed(one, d_hat @ m["c1"].T) + self.summed(two, d_hat @ m["c2"].T)
        self.move("c1", r1.T @ d_hat)
        self.move("c2", r2.T @ d_hat)
        self.move("q", d_q)
        self.move("r", d_r)


def rows_of(model: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters as rows of WIDTH + 1 numbers."""
    wide = lambda a: a if a.shape[1] > WIDTH else np.column_stack([a, np.zeros(len(a), np.float32)])
    return np.concatenate([wide(model[k]) for k in ("r", "q", "c1", "c2")])


def model_of(rows: np.ndarray) -> dict[str, np.ndarray]:
    n = len(rows) // 2 - WIDTH
    r, q, c1, c2 = np.split(rows.astype(np.float32), [n, 2 * n, 2 * n + WIDTH])
    return {"r": r[:, :WIDTH], "q": q, "c1": c1[:, :WIDTH], "c2": c2[:, :WIDTH]}


def encoded(docs: DataFrame, sent) -> DataFrame:
    """(o, kinds): of each row a hash that orders rows, and its tokens' classes, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(sent.value.kind_of)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                words, lengths = words_of(part.column("text").cast(pa.binary()).to_pylist())
                kinds = codes.of(words).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column("o"), pa.array([k.tobytes() for k in np.split(kinds, lengths.cumsum()[:-1])], pa.binary())], names=["o", "kinds"])

    return docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("o")).mapInArrow(run, schema_of("o long, kinds binary"))


def trained(docs: DataFrame, lexicon: Lexicon, sent) -> dict[str, np.ndarray]:
    """The model after ROUNDS over disjoint parts of ``docs``.

    A part is dealt into shards by a hash of id and text, about SHARD_TOKENS each, so their number follows the corpus. A
    shard takes its steps in the order of that hash, in batches of one size, whatever task it is in, and the shards'
    parameters are averaged as whole numbers, so the model doesn't depend on how files or tasks are cut.
    """
    model = start_model(lexicon.unigram)
    rows = stored(encoded(docs, sent), "lm-kinds")
    shards = max(1, -(-lexicon.n // (ROUNDS * SHARD_TOKENS)))
    rows = rows.select(F.pmod("o", F.lit(ROUNDS)).cast("int").alias("part"), F.pmod(F.shiftright("o", 8), F.lit(shards)).cast("int").alias("shard"), "o", "kinds")
    for k in range(ROUNDS):
        start = docs.sparkSession.sparkContext.broadcast((model, lexicon.unigram))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            shard, trainer, waiting, many = None, None, [], 0

            def steps(at_end: bool) -> None:
                nonlocal waiting, many
                whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
                stop = many if at_end else many - many % BATCH
                for i in range(0, stop, BATCH):
                    trainer.step(*(x[i : min(i + BATCH, stop)] for x in whole))
                waiting, many = [tuple(x[stop:] for x in whole)], many - stop

            def finished() -> pa.RecordBatch:
                if many:
                    steps(True)
                whole = np.rint(rows_of(trainer.m).astype(np.float64) * FIXED).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(list(whole), pa.list_(pa.int64()))], names=["i", "v"])

            for b in batches:
                for s, raw in zip(b.column("shard").to_pylist(), b.column("kinds").to_pylist(), strict=True):
                    if s != shard:
                        if trainer:
                            yield finished()
                        shard, trainer, waiting, many = s, Trainer(*start.value), [], 0
                    kind = np.frombuffer(raw, np.uint16).astype(np.int64)
                    waiting.append((*contexts(kind, np.array([len(kind)])), kind))
                    many += len(kind)
                    if many >= 16 * BATCH:
                        steps(False)
            if trainer:
                yield finished()

        dealt = rows.where(F.col("part") == k).select("shard", "o", "kinds").repartition("shard").sortWithinPartitions("shard", "o", "kinds")
        sums = dealt.select("shard", "kinds").mapInArrow(run, schema_of("i int, v array<long>")).groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(WIDTH + 1)), F.count("*").alias("n"))
        got = sums.toPandas().sort_values("i")  # a row for each parameter row
        if len(got):
            model = model_of(got[[f"v{j}" for j in range(WIDTH + 1)]].to_numpy() / FIXED / got[["n"]].to_numpy())
    return model


class Scorer:
    """Normalised log probabilities of classes in all contexts of two, by matrix products."""

    def __init__(self, model: dict[str, np.ndarray]) -> None:
        q, bias = model["q"][:, :WIDTH], model["q"][:, WIDTH].astype(np.float64)
        bias = bias.copy()
        bias[0] = -np.inf  # what stands before a text never follows
        self.a1, self.a2 = (np.clip(model["r"] @ model[c] @ q.T, -25, 25).astype(np.float32) for c in ("c1", "c2"))
        self.bias = bias
        z = (np.exp(self.a1) * np.exp(bias).astype(np.float32)) @ np.exp(self.a2).T
        self.log_z = np.log(z).astype(np.float32)

    def __call__(self, one: np.ndarray, two: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 p(kind | one, two)."""
        return (self.a1[one, kind] + self.a2[two, kind] + self.bias[kind] - self.log_z[one, two]) / np.log(10)


def score(docs: DataFrame, train: Column, keys: list[str]) -> DataFrame:
    """``keys``, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``; learned from those where ``train``."""
    counts = stored(count_words(docs.where(train)), "lm-counts")
    lexicon = Lexicon(counts)
    listed = docs.sparkSession.sparkContext.broadcast(lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs.where(train), lexicon, listed))
    schema = T.StructType([*(docs.schema[k] for k in keys), *schema_of("_n long, _known long, _base double, _score double, _h array<long>, _m array<int>").fields])
    held = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        x = listed.value
        if not held:
            held.extend([Scorer(sent.value), Codes(x.place)])
        words, lengths = words_of(cols["text"])
        at = held[1].of(words)
        kind = x.kind[at]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        base = np.add.reduceat(x.log_c[at], starts) - lengths * np.log10(x.n + x.v + 1)
        own = np.add.reduceat(held[0](*contexts(kind, lengths), kind) + x.share[at], starts)
        known = np.add.reduceat((at < x.known).astype(np.int64), starts)
        rest = [Counter(words[s : s + n][i] for i in np.flatnonzero(at[s : s + n] >= x.known)) if n > k else {} for s, n, k in zip(starts.tolist(), lengths.tolist(), known.tolist(), strict=True)]
        out = {k: cols[k] for k in keys} | {"_n": lengths, "_known": known, "_base": base, "_score": own}
        return out | {"_h": [[name_of(w) for w in r] for r in rest], "_m": [list(r.values()) for r in rest]}

    partly = map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema)
    partly = stored(partly.withColumn("_row", F.monotonically_increasing_id()), "lm-partly")
    rest = partly.where(F.size("_h") > 0).select("_row", F.explode(F.arrays_zip("_h", "_m")).alias("x")).select("_row", F.col("x._h").alias("h"), F.col("x._m").alias("m"))
    known = rest.join(counts.select("h", "c"), "h").groupBy("_row").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("_more"), F.sum("m").alias("_also"))
    more = F.coalesce(F.col("_more"), F.lit(0.0))
    return partly.drop("_h", "_m").join(known, "_row", "left").select(
        *keys, F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce(F.col("_also"), F.lit(0))).alias("n_known"), F.lit(lexicon.n).cast("long").alias("train_tokens"),
        (F.col("_base") + more).alias("base_score"), (F.col("_score") + more).alias("score"),
    )
