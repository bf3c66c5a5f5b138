"""What the corpus operators share: reading, Arrow batches, word hashes, held-out folds, scratch tables.

Whatever crosses a task here is a column of Arrow arrays; texts are handled as UTF-8 bytes where the
contract speaks of ASCII classes, because ``bytes.lower``/``bytes.split`` are exactly "A-Z to a-z" and
"split at 0x20, 0x09-0x0D".
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a task holds as Python objects at a time.
SLICE_ROWS = 256
#: Rows of an Arrow batch between the JVM and a Python worker, set where the session has Spark's default.
BATCH_ROWS = 1024
#: Entries of a worker's word cache; it is emptied when full, so memory stays bounded on any vocabulary.
CACHE_WORDS = 250_000
#: Bytes of text of such a slice, where a text doesn't exceed them alone.
SLICE_BYTES = 4 << 20

#: Spark's setting by which a query's shuffle files go when it ends, rather than when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

WHITE = b" \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, modulus: int, missing: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; ``missing`` for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(missing))


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType, binary: tuple[str, ...] = ("text",)) -> DataFrame:
    """``df`` through ``fn``, a slice of rows at a time: lists by column in, lists by column out (any length).

    Columns named in ``binary`` arrive as UTF-8 bytes.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                cols = {}
                for name, col in zip(part.schema.names, part.columns, strict=True):
                    if name in binary and not pa.types.is_binary(col.type):
                        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
                    cols[name] = col.to_pylist()
                out = fn(cols)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def sized_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with the values of a text column as UTF-8 bytes: SLICE_ROWS rows and about SLICE_BYTES bytes at most."""
    for b in batches:
        text = b.column(column)
        text = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
        total = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(total, total[at] + SLICE_BYTES, side="right")) - 1
            to = min(max(to, at + 1), at + SLICE_ROWS, b.num_rows)
            yield b.slice(at, to - at), text.slice(at, to - at).to_pylist()
            at = to


class WordHashes(dict):
    """bytes word -> 64-bit hash, kept for repeated words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash for the sequence of the parts, element by element (order matters)."""
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables under the one that all executors share.

    That is ``spark.checkpoint.dir`` as the cluster sets it; where it is unset (tests), one is set once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; on one machine without one a temporary one, on a cluster that is an error."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


_SCOPES = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored within, but for those stored with ``last``, are deleted at the end: what is returned mustn't read them."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in scopes.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def stored(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps don't recompute it and survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    scopes = _SCOPES.__dict__.get("open")
    if scopes and not last:
        scopes[-1].append(path)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
