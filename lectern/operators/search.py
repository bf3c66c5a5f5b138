"""Batches of questions: nearest vectors, keywords, time ranges, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, clock, parse_clock, query_terms
from .nearest import nearest
from .scans import running, time_bucket
from .spans import overlap_join


def search_segments(questions: DataFrame, segments: DataFrame, k: int = 8) -> DataFrame:
    """The k segments of the question's video that are nearest."""
    return nearest(questions, segments, ["q_id"], k)


def search_entries(questions: DataFrame, entries: DataFrame, indexes: DataFrame, k: int = 8) -> DataFrame:
    """The k entries of each ready index of the question's video that are nearest."""
    ready = entries.join(indexes.where("status = 'ready'").select("index_id"), "index_id", "left_semi")
    return nearest(questions, ready, ["q_id", "index_id"], k)


def merge_hits(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Hits (q_id, group_no, id, distance) of several groups as one list of ``limit``: the best of each group first in, filled with the best of the rest, by distance."""
    g = Window.partitionBy("q_id", "group_no").orderBy("distance", "id")
    h = hits.withColumn("_r", F.row_number().over(g)).where(F.col("_r") <= limit)
    q = Window.partitionBy("q_id")
    h = h.withColumn("_n", F.sum((F.col("_r") == 1).cast("int")).over(q))  # a group has one first hit
    h = h.withColumn("_picked", F.col("_r") <= F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_n"))))
    # the rest in the same order: how many of it come before, and what stays, is counted along one sort
    order = q.orderBy("distance", F.col("_picked").desc(), "group_no", "_r").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_many", F.sum(F.col("_picked").cast("int")).over(q)).withColumn("_fill", F.sum((~F.col("_picked")).cast("int")).over(order))
    h = h.withColumn("_stays", F.col("_picked") | (F.col("_fill") <= limit - F.col("_many"))).withColumn("place", F.sum(F.col("_stays").cast("int")).over(order).cast("int"))
    return h.where(F.col("_stays") & (F.col("place") <= limit)).select("q_id", "place", "group_no", "id", "distance")


def _trigrams(text: Column) -> Column:
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))))


def find_segments(questions: DataFrame, segments: DataFrame, limit: int = 12) -> DataFrame:
    """The first segments of the question's video whose text has one of the question's terms, without regard to case.

    A term (four letters or more) is looked up by the trigram of it that fewest segments of the video have: postings are made of the
    trigrams that are asked for alone, and only what they give is searched for the term. So a question doesn't meet all
    segments of its video, and a video's postings are dealt by trigram.
    """
    terms = questions.select("q_id", "video_id", F.explode(F.array_distinct(F.transform(query_terms(F.col("question")), F.lower))).alias("_term"))
    asked = terms.withColumn("_tri", F.explode(_trigrams(F.col("_term"))))
    told = segments.join(questions.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "position", F.explode(_trigrams(F.lower("text"))).alias("_tri"))
    postings = told.join(asked.select("video_id", "_tri").distinct(), ["video_id", "_tri"], "left_semi")
    many = postings.groupBy("video_id", "_tri").agg(F.count("*").alias("_n"))
    # a trigram that no segment has rules its term out
    rare = asked.join(many, ["video_id", "_tri"], "left").groupBy("q_id", "video_id", "_term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_tri").alias("tri"))).alias("_r")).where("_r.n > 0")
    found = rare.select("q_id", "video_id", "_term", F.col("_r.tri").alias("_tri")).join(postings, ["video_id", "_tri"]).groupBy("q_id", "video_id", "position").agg(F.collect_set("_term").alias("_terms"))
    met = found.join(segments, ["video_id", "position"]).where(F.exists("_terms", lambda t: F.contains(F.lower(F.col("text")), t)))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy("position"))).where(F.col("place") <= limit).drop("_terms")


def segments_between(windows: DataFrame, segments: DataFrame, limit: int = 40) -> DataFrame:
    """The first segments that overlap each window (w_id, video_id, start_ms, end_ms), ends included."""
    met = overlap_join(windows, segments.select("video_id", "position", "start_ms", "end_ms", "speaker", "text"), inclusive=True)
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("w_id").orderBy("r_position"))).where(F.col("place") <= limit)
    return placed.select("w_id", "video_id", "place", F.col("r_position").alias("position"), F.col("r_text").alias("text"))


def citations(hits: DataFrame) -> DataFrame:
    """Each question's hits as a JSON list in order of rank; the type is a hit's source, where there is such a column."""
    source = F.col("source") if "source" in hits.columns else F.lit("segment")
    c = F.struct(source.alias("type"), F.col("id").alias("segmentId"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.coalesce("speaker_name", F.lit("")).alias("speakerName"), "text")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", c.alias("c")))), lambda x: x["c"])
    return hits.groupBy("q_id").agg(F.to_json(listed).alias("citations"))


def result_lines(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Each question's first hits as lines "[m:ss–m:ss] who: text"."""
    who = F.coalesce("speaker", "speaker_name")
    line = F.concat(F.lit("["), clock(F.col("start_ms") / 1000), F.lit("–"), clock(F.col("end_ms") / 1000), F.lit("] "), F.when(F.coalesce(who, F.lit("")) != "", F.concat(who, F.lit(": "))).otherwise(""), "text")
    rows = hits.where(F.col("place") <= limit).groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("_l"))
    return rows.select("q_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("lines"))


STAMP = r"\d{1,3}:\d{2}(?::\d{2})?"


def read_window(actions: DataFrame, default: float = 60.0, most: float = 240.0) -> DataFrame:
    """actions with read_start and read_end in seconds, from the marks in start and end, or in range, or from start as a range.

    A missing end, or one that isn't after the start, is ``default`` seconds later; none is later than ``most`` seconds.
    Without a start both are null.
    """
    pair = rf"@?\[?\s*({STAMP})\s*[–—-]\s*@?({STAMP})\s*\]?"
    joined = F.when(F.coalesce("range", F.lit("")) != "", F.col("range")).when(F.col("start").rlike(pair), F.col("start"))
    mark = lambda k, own: parse_clock(F.when(joined.rlike(pair), F.regexp_extract(joined, pair, k)).otherwise(F.col(own)))
    rows = actions.withColumn("read_start", mark(1, "start")).withColumn("_end", mark(2, "end"))
    end = F.when(F.col("_end") > F.col("read_start"), F.col("_end")).otherwise(F.col("read_start") + default)
    return rows.withColumn("read_end", F.least(end, F.col("read_start") + most)).drop("_end").withColumn("read_end", F.when(F.col("read_start").isNotNull(), F.col("read_end")))


def list_entries(entries: DataFrame, indexes: DataFrame, limit: int = 60) -> DataFrame:
    """Entries of ready indexes by start and id."""
    ready = entries.join(indexes.where("status = 'ready'").select("index_id"), "index_id", "left_semi")
    return ready.withColumn("place", F.row_number().over(Window.partitionBy("index_id").orderBy("start_ms", "id"))).where(F.col("place") <= limit)


def quote_token(segments: DataFrame, most: int = 48) -> DataFrame:
    """Segments with a token that quotes them: @[preview… m:ss-m:ss]."""
    mark = F.concat(clock(F.col("start_ms") / 1000), F.lit("-"), clock(F.col("end_ms") / 1000))
    return segments.withColumn("token", F.concat(F.lit("@["), clip(F.regexp_replace("text", r"[\[\]]", ""), most), F.lit(" "), mark, F.lit("]")))


def asof_segment(positions: DataFrame, segments: DataFrame, early_ms: int = 150) -> DataFrame:
    """For each playback position (video_id, p_id, at_ms) the last segment that has begun by then, or -1: one scan of both by time buckets, no range join."""
    p = positions.select("video_id", F.col("at_ms").alias("t"), F.lit(1).alias("kind"), "p_id", F.lit(None).cast("long").alias("segment"))
    s = segments.select("video_id", (F.col("start_ms") - early_ms).alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("p_id"), F.col("position").cast("long").alias("segment"))
    met = running(p.union(s), ["video_id"], ["t", "kind", "segment"], time_bucket("t"), {"_active": (F.col("segment"), "last")}, own=True)
    return met.where("kind = 1").select("video_id", "p_id", F.coalesce("_active", F.lit(-1)).alias("active"))


def asof_word(positions: DataFrame, segments: DataFrame, early_ms: int = 30) -> DataFrame:
    """For each position in its active segment (video_id, p_id, at_ms, active) the last word that has begun by then, or -1."""
    s = segments.select("video_id", F.col("position").alias("active"), "words")
    begun = F.size(F.filter("words", lambda w: w["start_ms"] <= F.col("at_ms") + early_ms))
    return positions.join(s, ["video_id", "active"], "left").select("video_id", "p_id", (F.greatest(F.coalesce(begun, F.lit(0)), F.lit(0)) - 1).alias("word"))
