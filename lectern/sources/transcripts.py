"""Transcripts in and out: nested documents, whole-video overwrites, dialogues as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .buckets import BUCKETS, Store

DOCUMENT = "video_id bigint, segments array<struct<start double, end double, speaker string, text string, words array<struct<text string, start double, end double>>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Segment rows of nested documents, one JSON object a file: video_id, position, start_ms, end_ms, speaker, text, words. Unreadable files are skipped."""
    return document_segments(spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path))


def document_segments(documents: DataFrame) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = documents.select("video_id", F.posexplode("segments").alias("position", "s"))
    return rows.select("video_id", F.col("position").cast("long").alias("position"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.speaker", "s.text", "s.words")


def transcript_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    """The tables segments and speakers (video_id, label, name) of a folder."""
    return Store(spark, path, ["video_id"], buckets)


def index_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Store:
    """The table entries of a folder."""
    return Store(spark, path, ["video_id", "index_id"], buckets)


def write_transcript(segments: DataFrame, path: str, videos: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replaces the transcripts of ``videos`` (default: those that segments holds), and no others, with their speakers' labels, in
    order of first mention and each its own name; a video without segments loses its transcript. Returns the version."""
    first = segments.where(F.col("speaker").isNotNull()).groupBy("video_id", F.col("speaker").alias("label")).agg(F.min("position").alias("_first"))
    no = F.row_number().over(Window.partitionBy("video_id").orderBy("_first"))
    labels = first.select("video_id", "label", no.alias("label_no"), F.col("label").alias("name"))
    return transcript_store(segments.sparkSession, path, buckets).replace(segments if videos is None else videos, {"segments": segments, "speakers": labels})


def write_index(entries: DataFrame, path: str, indexes: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replaces the ``indexes`` (video_id, index_id; default: those that entries holds), and no others. Returns the version."""
    return index_store(entries.sparkSession, path, buckets).replace(entries if indexes is None else indexes, {"entries": entries})


def mark_ready(indexes: DataFrame, entries: DataFrame) -> DataFrame:
    """The indexes after a build: one that was building is ready if it has entries, else an error; others stay as they are."""
    have = entries.select("video_id", "index_id").distinct().withColumn("_have", F.lit(True))
    done = F.when(F.col("status") != "building", F.col("status")).when(F.col("_have"), "ready").otherwise("error")
    return indexes.join(have, ["video_id", "index_id"], "left").withColumn("status", done).drop("_have")


def export_dialogue(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """video_id, file_name, dialogue: {title, messages} as JSON; without speakers where diarization was off (opt_diarize false)."""
    message = F.struct(F.when(F.coalesce("opt_diarize", F.lit(True)), F.col("speaker_name")).alias("speaker"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "text")
    rows = segments.join(videos.select("video_id", "title", "opt_diarize"), "video_id").select("video_id", "title", "position", message.alias("m"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("position", "m"))), lambda x: x["m"])
    whole = rows.groupBy("video_id", "title").agg(F.to_json(F.struct(F.col("title"), told.alias("messages"))).alias("dialogue"))
    name = F.regexp_replace(F.trim(F.regexp_replace("title", r"[^\p{L}\p{N}]+", " ")), r"\s+", "-")
    return whole.select("video_id", F.concat(F.when(name == "", "dialog").otherwise(name), F.lit(".json")).alias("file_name"), "dialogue")
