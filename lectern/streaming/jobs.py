"""Streams: turns of chunks as they arrive, chunk results once, clocks of stages, counts, sessions, missing vectors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import library, voices
from ..operators.embedding import Model, embed
from ..sources.scratch import shared_folder


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's, one file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern, as a stream takes no single file by its path
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.{{parquet}}")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which value, list and map states and timers need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def started(stream: DataFrame, place: str) -> StreamingQuery:
    """The stream to the end of the input there is now, appended to the files of {place}/rows; goes on where it ended."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    with rocks(stream.sparkSession):
        query = writer.format("parquet").option("path", f"{place}/rows").start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the watermark in the query's recent progress."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all input there is now, through files in the shared checkpoint folder: all appended rows, or the last
    complete result."""
    if mode not in ("append", "complete"):
        raise ValueError("append or complete")
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        started(stream, place)
    else:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", every: str | None = None) -> DataFrame:
    """Events by kind and window of created_at, a new one ``every`` so often (default: one after the other).

    In append mode a window is told once, when the watermark has passed its end, and its state goes; rows that are
    later still are left out and counted (late_rows).
    """
    return library.event_counts(events.withWatermark("created_at", late), width, every)


def heartbeat_sessions(events: DataFrame, late: str = "10 minutes", gap: str = "900 seconds") -> DataFrame:
    """Sessions of work that a silence ends; in append mode each once, when it can't go on any more."""
    return library.heartbeat_sessions(events.withWatermark("created_at", late), gap)


def append_asr(chunks: DataFrame, late: str = "1 hour") -> DataFrame:
    """video_id, chunk_no, start_ms, end_ms, text: each chunk's segments once, in the video's time.

    chunks: video_id, chunk_no, created_at, offset_ms, segments array<struct<start_ms, end_ms, text>>.
    """
    once = chunks.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["video_id", "chunk_no"])
    rows = once.select("video_id", "chunk_no", "offset_ms", F.explode("segments").alias("s"))
    return rows.select("video_id", "chunk_no", (F.col("s.start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("s.end_ms") + F.col("offset_ms")).alias("end_ms"), "s.text")


class Stitching(StatefulProcessor):
    """voices.stitch_chunk with a video's state kept apart: what is done (a value), the turns that later chunks can look back
    to (a list) and the voices (a map by speaker). An event-time timer ends a video that has had no chunk for ``idle_ms``."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "done long, next int, timer long")
        self.turns = handle.getListState("turns", voices.TURNS)
        self.gallery = handle.getMapState("gallery", "speaker string", "vector array<double>, weight double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, timer = voices.begin(), None
        if self.at.exists():
            state["done"], state["next"], timer = self.at.get()
            state["turns"] = [tuple(t) for t in self.turns.get()]
            state["gallery"] = {k[0]: (list(v), w) for k, (v, w) in self.gallery.iterator()}
        had = dict(state["gallery"])
        out, last = [], 0
        for b in sorted((r for df in rows for r in df.itertuples(index=False)), key=lambda r: r.chunk_no):
            last = max(last, int(b.at_ms))
            out += [(key[0], b.chunk_no, *t) for t in voices.stitch_chunk(state, int(b.end_ms), json.loads(b.turns or "[]"), json.loads(b.voices or "{}"))]
        due = max(last + self.idle_ms, timer or 0)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.at.update((state["done"], state["next"], due))
        self.turns.put([tuple(t) for t in state["turns"]]) if state["turns"] else self.turns.clear()
        for k, v in state["gallery"].items():
            if had.get(k) != v:
                self.gallery.updateValue((k,), (list(map(float, v[0])), float(v[1])))
        yield pd.DataFrame(out, columns=["video_id", "chunk_no", "start_ms", "end_ms", "speaker"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        for state in (self.at, self.turns, self.gallery):
            state.clear()
        yield pd.DataFrame([], columns=["video_id", "chunk_no", "start_ms", "end_ms", "speaker"])

    def close(self) -> None:
        pass


def stitch_turns(chunks: DataFrame, late: str = "1 hour", idle_ms: int = 7_200_000) -> DataFrame:
    """operators.voices.stitch_turns on a stream of chunks with created_at; chunks that come again, or after a later one, give nothing.

    A video's state goes idle_ms of event time after its last chunk, when what might repeat is late for the watermark.
    Needs the state store on RocksDB (``finished`` sets it).
    """
    told = voices.packed(chunks).withWatermark("created_at", late)
    told = told.select("video_id", "chunk_no", "end_ms", "turns", "voices", "created_at", F.unix_millis("created_at").alias("at_ms"))
    return told.groupBy("video_id").transformWithStateInPandas(Stitching(idle_ms), f"video_id long, chunk_no long, {voices.TURNS}", "Append", "EventTime")


def stage_times(changes: DataFrame) -> DataFrame:
    """video_id, stage, us (microseconds): closed clocks of changes (video_id, id, stage, created_at) of a table."""
    after = F.lead("created_at").over(Window.partitionBy("video_id").orderBy("created_at", "id"))
    us = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = changes.select("video_id", "stage", us.alias("us")).where(F.col("us").isNotNull() & ~F.col("stage").isin(*FINAL))
    return rows.groupBy("video_id", "stage").agg(F.sum("us").alias("us"))


#: Stages after which a video's clock doesn't run.
FINAL = ("ready", "error")


def stage_clocks(changes: DataFrame) -> DataFrame:
    """video_id, stage, us (microseconds), late: a row for each closed clock of a stream of changes; their sums by stage are stage_times.

    The state is a video's open stage, which ends with a stage of FINAL. A change older than the state can't be set
    in any more: it gives a row with late and no us, so that what a stream lacks against the table is counted. A video's
    rows of one micro-batch are put in order in memory; the source's limit a trigger (maxFilesPerTrigger,
    maxBytesPerTrigger) bounds them.
    """

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else None
        rows = []
        for r in pd.concat(batches).sort_values(["at_us", "id"]).itertuples(index=False):
            if at is not None and r.at_us < at[1]:
                rows.append((key[0], r.stage, None, True))
                continue
            if at is not None:
                rows.append((key[0], at[0], int(r.at_us) - at[1], False))
            at = None if r.stage in FINAL else (r.stage, int(r.at_us))
        if at is not None:
            state.update(at)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["video_id", "stage", "us", "late"]).astype({"us": "Int64"})

    told = changes.select("video_id", "id", "stage", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at_us"))
    return told.groupBy("video_id").applyInPandasWithState(close, "video_id long, stage string, us long, late boolean", "stage string, at_us long", "append", GroupStateTimeout.NoTimeout)


def refill(stream: DataFrame, videos: Callable[[], DataFrame], text: str, model: Model, dim: int, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the job that gives rows without a vector one, as far as their video is ready. Returns the query.

    ``videos`` reads the videos (video_id, status) anew for each micro-batch. Rows of those that aren't ready wait for a later
    batch. Batch n writes {path}/rows/batch=n and {path}/waiting/batch=n over what a failed try of it has left, so a row is there
    once however often the job is stopped.
    """
    missing = stream.where("embedding is null").drop("embedding")
    kept = missing.schema

    def fill(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        if n:
            df = df.unionByName(spark.read.schema(kept).parquet(f"{path}/waiting/batch={n - 1}"))
        told = df.join(videos().where("status = 'ready'").select("video_id", F.lit(True).alias("_ready")).distinct(), "video_id", "left").select(*df.columns, "_ready").persist()
        try:
            embed(told.where("_ready").drop("_ready"), text, model, dim).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
            told.where("_ready is null").drop("_ready").write.mode("overwrite").parquet(f"{path}/waiting/batch={n}")
        finally:
            told.unpersist()

    return missing.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fill).start()


def refilled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that ``refill`` has given vectors (schema: the stream's)."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
