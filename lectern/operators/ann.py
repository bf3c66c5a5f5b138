"""Search over all videos at once by an index of lists: approximate candidates from codes, distances exact.

Rows are put into the list of their nearest centre, and what is left of them is written as a code of one byte for each
stretch of STRETCH numbers. A question looks into its ``probes`` nearest lists, ranks their rows by the codes, and the
``rerank`` best are compared exactly. The index holds every row with a vector; only centres and code books come from a sample of SAMPLE
rows at most, those of least hash. ``nearest`` over one constant key is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import BLOCK, Q_BLOCK, least_of, matrices, nearest

#: Rows that centres and code books are fitted on at most, numbers a byte of code stands for, and rounds of fitting.
SAMPLE, STRETCH, ROUNDS = 20_000, 2, 12
#: Rows of the sample that a list has at least, on average.
ROWS_A_LIST = 25
CODES = 256


@dataclass(frozen=True)
class Quantizer:
    centres: np.ndarray  # list, number
    books: np.ndarray  # stretch, code, number

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Vectors by stretch: (row, stretch, number), with zeros after the end."""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        lists = (x @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1)
        rest = self.cut(x - self.centres[lists])
        return lists, np.stack([(rest[:, p] @ b.T - (b**2).sum(1) / 2).argmax(1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def products(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Dot products of questions with coded rows: (question, row)."""
        out = (q @ self.centres.T)[:, lists]
        for p, book in enumerate(self.books):
            out += (self.cut(q)[:, p] @ book.T)[:, codes[:, p]]
        return out


def means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means: centres of the vectors, k at most."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        many = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centres)
    return centres


def fit(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Quantizer:
    """Centres and code books from the ``sample`` rows of least hash; of the vectors' lengths the most frequent one counts."""
    known = rows.where(F.col("embedding").isNotNull()).select("id", "embedding")
    taken = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).toArrow()
    parts = matrices(taken.column("embedding"))
    x = max((m for _, m in parts), key=len, default=np.zeros((1, 1)))
    if not len(x):
        x = np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    lists = max(1, len(x) // ROWS_A_LIST) if lists is None else lists
    centres = means(x, min(lists, round(4 * np.sqrt(len(x)))) or 1, rng)
    q = Quantizer(centres, np.zeros((-(-x.shape[1] // STRETCH), 1, STRETCH)))
    rest = q.cut(x - centres[(x @ centres.T - (centres**2).sum(1) / 2).argmax(1)])
    books = [means(rest[:, p], CODES, rng) for p in range(rest.shape[1])]
    return Quantizer(centres, np.stack(books))


def index_rows(rows: DataFrame, q: Quantizer) -> DataFrame:
    """id, list_no and code of every row whose vector has the quantizer's length; others (id alone) have nulls: they are no neighbours."""
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            lists, codes = [None] * batch.num_rows, [None] * batch.num_rows
            for places, x in matrices(batch.column("embedding")):
                if x.shape[1] == q.centres.shape[1] and len(x):
                    for i, n, c in zip(places.tolist(), *q.coded(x), strict=True):
                        lists[i], codes[i] = int(n), c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, pa.int32()), pa.array(codes, pa.binary())], names=["id", "list_no", "code"])

    return rows.select("id", "embedding").mapInArrow(run, f"id {kind}, list_no int, code binary")


def candidates(index: DataFrame, questions: DataFrame, q: Quantizer, probes: int, rerank: int) -> DataFrame:
    """q_id, id: each question's ``rerank`` rows that the codes put nearest. Lists are dealt in blocks, so a large one is several tasks."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(q)
    q_kind, kind = questions.schema["q_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value.centres
        for batch in batches:
            at, lists, vectors = [], [], []
            for places, x in matrices(batch.column("q_vec")):
                if x.shape[1] == centres.shape[1] and len(x):
                    i, j = least_of(((centres**2).sum(1) / 2 - x @ centres.T), min(probes, len(centres)))
                    at += places[i].tolist()
                    lists += j.tolist()
                    vectors += list(x[i])
            yield pa.RecordBatch.from_arrays([batch.column("q_id").take(pa.array(at, pa.int64())), pa.array(lists, pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], names=["q_id", "list_no", "q_vec"])

    told = questions.select("q_id", "q_vec").mapInArrow(asked, f"q_id {q_kind}, list_no int, q_vec array<double>")
    known = index.where(F.col("list_no").isNotNull())
    sizes = F.broadcast(known.groupBy("list_no").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_many")))  # a line a list, as many as centres
    rows = known.join(sizes, "list_no").select("list_no", F.pmod(F.xxhash64("id"), "_many").cast("int").alias("block"), "id", "code")
    told = told.join(sizes, "list_no").select("q_id", "list_no", "q_vec", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)).alias("block"))

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        q, out = sent.value, []
        if right.num_rows and left.num_rows:
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            lists = right.column("list_no").to_numpy()
            for at in range(0, left.num_rows, Q_BLOCK):
                part = left.slice(at, Q_BLOCK)
                x = part.column("q_vec").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
                far = -q.products(x, lists, codes)
                i, j = least_of(far, rerank)
                out.append((i + at, j, far[i, j]))
        i, j, far = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([left.column("q_id").take(pa.array(i)), right.column("id").take(pa.array(j)), pa.array(far)], names=["q_id", "id", "far"])

    met = told.groupBy("list_no", "block").cogroup(rows.groupBy("list_no", "block")).applyInArrow(ranked, f"q_id {q_kind}, id {kind}, far double")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("far", "id"))
    return met.withColumn("_place", place).where(F.col("_place") <= rerank).select("q_id", "id")


def search(index: DataFrame, questions: DataFrame, rows: DataFrame, q: Quantizer, k: int = 8, probes: int = 12, rerank: int = 64) -> DataFrame:
    """q_id, id, distance and rank: of the candidates of each question (q_id, q_vec) the k nearest, exactly."""

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (np.stack(b[c].to_numpy()).astype(float) if len(b) else np.zeros((0, 1)) for c in ("q_vec", "embedding"))
            dot = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pd.DataFrame({"q_id": b["q_id"], "id": b["id"], "distance": np.rint((1 - dot) * 1e6) / 1e6})

    near = candidates(index, questions, q, probes, rerank)
    both = near.join(questions.select("q_id", "q_vec"), "q_id").join(rows.select("id", "embedding"), "id")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((questions, "q_id"), (rows, "id"))]
    told = both.select("q_id", "id", "q_vec", "embedding").mapInPandas(exact, f"q_id {kinds[0]}, id {kinds[1]}, distance double")
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def search_exact(questions: DataFrame, rows: DataFrame, k: int = 8) -> DataFrame:
    """The same without an index: all rows against all questions, in blocks."""
    one = F.lit(0).alias("_all")
    return nearest(questions.select("q_id", "q_vec", one), rows.select("id", "embedding", one), ["q_id"], k, on="_all").select("q_id", "id", "distance", "rank")
