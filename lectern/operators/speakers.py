"""Speakers of segments: assignment by overlap, labels, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clock
from .spans import overlap_join

NO_SPEAKER = "Без спикера"


def assign_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Each segment with the speaker of the one turn that overlaps it most; ties to the first turn; none: null."""
    s = segments.drop("speaker")
    met = overlap_join(s.select("video_id", "position", "start_ms", "end_ms"), turns.select("video_id", "turn_no", "start_ms", "end_ms", "speaker"))
    over = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    best = met.groupBy("video_id", "position").agg(F.max_by("r_speaker", F.struct(over, -F.col("r_turn_no"))).alias("speaker"))
    return s.join(best, ["video_id", "position"], "left")


def seam_overlap(previous: DataFrame, local: DataFrame) -> DataFrame:
    """Seconds (ms) that each local speaker shares with each global one: video_id, local, global, overlap_ms."""
    met = overlap_join(local.select("video_id", "speaker", "start_ms", "end_ms"), previous.select("video_id", "speaker", "start_ms", "end_ms"))
    over = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    return met.groupBy("video_id", F.col("speaker").alias("local"), F.col("r_speaker").alias("global")).agg(F.sum(over).alias("overlap_ms"))


def speaker_labels(segments: DataFrame) -> DataFrame:
    """A video's labels in order of first appearance: video_id, label, label_no, name."""
    first = segments.where("speaker is not null").groupBy("video_id", F.col("speaker").alias("label")).agg(F.min("position").alias("_first"))
    return first.select("video_id", "label", F.row_number().over(Window.partitionBy("video_id").orderBy("_first")).alias("label_no"), F.col("label").alias("name"))


def with_speaker_name(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """speaker_name: the label's name in its video, else the label, else a fixed word."""
    s = speakers.select("video_id", F.col("label").alias("speaker"), F.col("name").alias("_name"))
    return segments.join(s, ["video_id", "speaker"], "left").withColumn("speaker_name", F.coalesce("_name", "speaker", F.lit(NO_SPEAKER))).drop("_name")


def hide_authors(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Speaker null and speaker_name empty where the video was added without diarization; unknown videos keep theirs."""
    off = videos.where("opt_diarize = false").select("video_id", F.lit(True).alias("_off"))
    joined = rows.join(off, "video_id", "left")
    return joined.withColumn("speaker", F.when(F.col("_off").isNull(), F.col("speaker"))).withColumn("speaker_name", F.when(F.col("_off"), F.lit("")).otherwise(F.col("speaker_name"))).drop("_off")


def rename_speakers(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows to embed anew after renames (video_id, label, name): video_id, position, embed_text."""
    c = changes.select("video_id", F.col("label").alias("speaker"), "name")
    return segments.join(c, ["video_id", "speaker"]).select("video_id", "position", F.concat("name", F.lit(": "), "text").alias("embed_text"))


def speaker_excerpt(segments: DataFrame, most: int = 24, picked: int = 22, limit: int = 10_000) -> DataFrame:
    """Lines of each speaker: all of ``most`` or fewer, else ``picked`` evenly spaced and the last two, under a character budget."""
    w = Window.partitionBy("video_id", "speaker")
    s = segments.where("speaker is not null").withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("start_ms", "position")) - 1)
    even = F.exists(F.sequence(F.lit(0), F.lit(picked - 1)), lambda i: F.floor(i * (F.col("_n") / float(picked))) == F.col("_i"))
    rows = s.where((F.col("_n") <= most) | even | (F.col("_i") >= F.col("_n") - 2))
    rows = rows.withColumn("line", F.concat(F.lit("["), clock(F.col("start_ms") / 1000), F.lit("] "), "speaker", F.lit(": "), "text"))
    o = w.orderBy("start_ms", "position")
    used = F.coalesce(F.sum(F.length("line") + 1).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = (used + F.length("line") > limit) & (F.row_number().over(o) > 1)
    kept = rows.withColumn("_over", over.cast("int")).withColumn("_over", F.max("_over").over(o.rowsBetween(Window.unboundedPreceding, 0))).where("_over = 0")
    return kept.select("video_id", "speaker", "position", "line")


def clean_voices(voices: DataFrame) -> DataFrame:
    """Voices with a label and a non-empty vector of finite numbers, rounded to 5 places."""
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return voices.where(F.col("label").isNotNull() & (F.size("vector") > 0) & finite).withColumn("vector", F.transform("vector", lambda x: F.bround(x.cast("double"), 5)))


def replace_mentions(messages: DataFrame, speakers: DataFrame, to: str = "label") -> DataFrame:
    """messages (video_id, text) with each "@Name" of a video's speakers as its label, or with to="name" as the bare name.

    Longer names first; case doesn't matter; a mention begins a word and ends before white space, a closing mark or the end.
    """
    named = speakers.where("trim(name) <> ''").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((-F.length(F.trim("name"))).alias("n"), F.trim("name").alias("name"), "label"))).alias("_names"))
    literal = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    pattern = lambda x: F.concat(F.lit(r"(?iu)(?<!\S)@\Q"), x["name"], F.lit(r"\E(?=$|[\s.,!?;:)\x22»])"))
    told = messages.join(named, "video_id", "left")
    new = F.aggregate("_names", F.col("text"), lambda acc, x: F.regexp_replace(acc, pattern(x), literal(x[to])))
    return told.withColumn("text", F.when(F.col("_names").isNull(), F.col("text")).otherwise(new)).drop("_names")


def labels_to_mentions(messages: DataFrame, speakers: DataFrame) -> DataFrame:
    """The way back: messages (video_id, text) with each label of a video's speakers as "@Name"."""
    named = speakers.where("trim(name) <> ''").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("label")).alias("n"), "label", F.trim("name").alias("name")))).alias("_names"))
    literal = lambda c: F.concat(F.lit("@"), F.regexp_replace(c, r"([\\$])", r"\\$1"))
    pattern = lambda x: F.concat(F.lit(r"(?U)(?<!\w)\Q"), x["label"], F.lit(r"\E(?!\w)"))
    told = messages.join(named, "video_id", "left")
    new = F.aggregate("_names", F.col("text"), lambda acc, x: F.regexp_replace(acc, pattern(x), literal(x["name"])))
    return told.withColumn("text", F.when(F.col("_names").isNull(), F.col("text")).otherwise(new)).drop("_names")
