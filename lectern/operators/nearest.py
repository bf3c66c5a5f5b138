"""Nearest rows by cosine: blocks of questions times blocks of rows as matrix products, k kept a block before the exchange.

Few questions (MOST_SENT at most, counted) are sent to every task, and the rows stay where they are read: an Arrow batch
is a block, so a video with all rows is as many tasks as it has input splits. More questions than that meet the rows in
a grid of blocks that are dealt by hash within each video, so neither side of a hot video is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Questions up to this number go to all tasks (at 768 numbers of 4 bytes each 60 MB).
MOST_SENT = 20_000
#: Rows and questions of a block of the grid, and distances that a task holds at once.
BLOCK, Q_BLOCK, HELD = 8_192, 2_048, 1 << 20
#: Distance of vectors of unlike lengths.
UNLIKE = 2.0

Matrices = list[tuple[np.ndarray, np.ndarray]]


def matrices(column: pa.Array | pa.ChunkedArray, least: float = 1e-8) -> Matrices:
    """(places, unit vectors) of an array of vectors, by their length; nulls and those shorter than ``least`` are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(size[size > 0]).tolist():
        places = np.flatnonzero(size == n)
        part = column if len(places) == len(column) else column.take(pa.array(places))
        x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        fit = norm >= least
        out.append((places[fit], x[fit] / norm[fit, None]))
    return out


def distances(questions: Matrices, rows: Matrices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the questions and of the rows, and 1 - cosine of each pair to six places."""
    q, r = (np.concatenate([p for p, _ in m]) if m else np.empty(0, np.int64) for m in (questions, rows))
    out = np.full((len(q), len(r)), UNLIKE)
    at = 0
    for _, x in questions:
        to = 0
        for _, y in rows:
            if x.shape[1] == y.shape[1]:
                d = x @ y.T
                np.subtract(1, d, out=d)
                d *= 1e6
                out[at : at + len(x), to : to + len(y)] = np.divide(np.rint(d, out=d), 1e6, out=d)
            to += len(y)
        at += len(x)
    return q, r, out


def least_of(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k least values, of equal ones the first."""
    if d.shape[1] > k:
        top = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero(d <= top)
    else:
        i, j = (x.ravel() for x in np.indices(d.shape))
    order = np.lexsort((j, d[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def top_pairs(questions: Matrices, rows: Matrices, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, distance) of each question's k nearest rows; of equally near ones the first by rank."""
    rows = [(p[o], x[o]) for p, x in rows for o in [np.argsort(rank[p], kind="stable")]]
    many, found = sum(len(p) for p, _ in rows), []
    step = max(1, HELD // max(1, many))
    for places, x in questions:
        for at in range(0, len(places), step):
            q, r, d = distances([(places[at : at + step], x[at : at + step])], rows)
            by = np.argsort(rank[r], kind="stable")
            i, j = least_of(d[:, by], k)
            found.append((q[i], r[by[j]], d[i, by[j]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found and many else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def groups_of(table: pa.Table | pa.RecordBatch, keys: list[str]) -> Iterator[np.ndarray]:
    """Places of the rows of each value of the keys; rows with a null key are left out."""
    code, known = np.zeros(table.num_rows, np.int64), np.ones(table.num_rows, bool)
    for k in keys:
        c = table.column(k)
        c = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).dictionary_encode()
        at = pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known &= at >= 0
        _, code = np.unique(code * (len(c.dictionary) + 1) + at, return_inverse=True)
    places = np.flatnonzero(known)
    places = places[np.argsort(code[places], kind="stable")]
    if len(places):
        yield from np.split(places, 1 + np.flatnonzero(np.diff(code[places])))


def rank_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Each value's place in order."""
    order = pc.sort_indices(column).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def block_pairs(questions: pa.Table, rows: pa.Table | pa.RecordBatch, groups: list[str], on: str, k: int, cache: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """top_pairs of the rows of each (on, groups) with the questions of the same ``on``."""
    if "by" not in cache:
        cache["by"] = {questions.column(on)[int(p[0])].as_py(): p for p in groups_of(questions, [on])}
    rank = rank_of(rows.column("id"))
    for places in groups_of(rows, [on, *groups]):
        key = rows.column(on)[int(places[0])].as_py()
        asked = cache["by"].get(key)
        if asked is None:
            continue
        if key not in cache:
            cache[key] = [(asked[p], x) for p, x in matrices(questions.column("q_vec").take(pa.array(asked)))]
        vectors = rows.column("embedding").take(pa.array(places))
        yield top_pairs(cache[key], [(places[p], x) for p, x in matrices(vectors)], rank, k)


def paired(schema: pa.Schema, asked: list[str], own: list[str], groups: list[str], on: str, k: int) -> Callable[[pa.Table, pa.Table, dict], pa.Table]:
    """The rows of ``schema`` for a table of questions and a block of rows."""

    def run(questions: pa.Table, rows: pa.Table, cache: dict) -> pa.Table:
        found = list(block_pairs(questions, rows, groups, on, k, cache))
        q, r, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        q, r = pa.array(q), pa.array(r)
        columns = [questions.column(c).take(q) for c in asked] + [rows.column(c).take(r) for c in own] + [pa.array(d)]
        return pa.Table.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def nearest(questions: DataFrame, rows: DataFrame, keys: list[str], k: int, on: str = "video_id", most_sent: int | None = None) -> DataFrame:
    """Of the rows (on, id, embedding, ...) with each question's ``on`` the k nearest by cosine distance for each of ``keys``;
    ties by id: the columns of both without the vectors, distance (six places) and rank.

    ``keys`` are columns of the questions and of the rows. Vectors without a direction are left out; those of unlike
    lengths are at distance 2.
    """
    asked, own = [c for c in questions.columns if c not in (on, "q_vec")], [c for c in rows.columns if c != "embedding"]
    groups = [c for c in keys if c not in questions.columns]
    spec = T.StructType([*(questions.schema[c] for c in asked), *(rows.schema[c] for c in own), T.StructField("distance", T.DoubleType())])
    schema = to_arrow_schema(spec)
    work = paired(schema, asked, own, groups, on, k)
    told = questions.select(*asked, F.col(on).cast(rows.schema[on].dataType).alias(on), "q_vec").where(F.col("q_vec").isNotNull() & F.col(on).isNotNull())
    known = rows.where(F.col("embedding").isNotNull())
    most_sent = MOST_SENT if most_sent is None else most_sent
    few = told.limit(most_sent + 1).toArrow()
    if few.num_rows <= most_sent:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, few.schema) as writer:
            writer.write_table(few.combine_chunks())
        sent = questions.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, cache = pa.ipc.open_stream(sent.value).read_all(), {}
            for batch in batches:
                yield from work(table, batch, cache).to_batches()

        met = known.mapInArrow(run, spec)
    else:
        met = grid(told, known, on, work, spec)
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "id"))).where(F.col("rank") <= k)


def grid(questions: DataFrame, rows: DataFrame, on: str, work: Callable[[pa.Table, pa.Table, dict], pa.Table], spec: T.StructType) -> DataFrame:
    """The questions of each ``on`` in blocks by its rows in blocks: each pair of blocks is a group of bounded size."""
    many = lambda df, size, name: df.groupBy(on).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = many(questions, Q_BLOCK, "_down").join(many(rows, BLOCK, "_across"), on)

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str, by: list[str]) -> DataFrame:
        at = F.pmod(F.xxhash64(*by), F.col(own)).cast("int").alias(mine)
        return df.join(sizes, on).select(*df.columns, at, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    q = dealt(questions, "_down", "_across", "_i", "_j", [c for c in questions.columns if c != on])
    r = dealt(rows, "_across", "_down", "_j", "_i", ["id"])
    deal = [on, "_i", "_j"]
    return q.groupBy(*deal).cogroup(r.groupBy(*deal)).applyInArrow(lambda a, b: work(a, b, {}), spec)
