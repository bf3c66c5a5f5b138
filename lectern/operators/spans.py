"""Interval algebra on (keys, start_ms, end_ms) rows, and joins on overlap. No task sees more than a key's time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import running, time_bucket

BUCKET_MS = 60_000


def union_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Touching and overlapping spans of a key merged: keys, start_ms, end_ms. Scanned by time buckets, so a long key is many tasks."""
    order = ["start_ms", "end_ms"]
    reached = running(spans.select(*keys, *order), keys, order, time_bucket("start_ms"), {"_reach": (F.col("end_ms"), "max")})
    new = F.when(F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach")), F.lit(1)).otherwise(0)
    marked = running(reached.withColumn("_new", new), keys, order, time_bucket("start_ms"), {"_island": (F.col("_new"), "sum")}, own=True)
    return marked.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def subtract_spans(spans: DataFrame, holes: DataFrame, keys: list[str], least_ms: int = 1000) -> DataFrame:
    """Spans without the holes; pieces shorter than least_ms are dropped. Spans of a key don't overlap."""
    h = union_spans(holes, keys)
    hit = overlap_join(spans.select(*keys, "start_ms", "end_ms"), h, keys).select(*keys, "start_ms", "end_ms", F.col("r_start_ms").alias("h_start"), F.col("r_end_ms").alias("h_end"))
    met = hit.unionByName(spans.select(*keys, "start_ms", "end_ms").join(hit, [*keys, "start_ms", "end_ms"], "left_anti"), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "start_ms", "end_ms").orderBy("h_start")
    left = met.select(*keys, F.coalesce(F.lag("h_end").over(w), F.col("start_ms")).alias("a"), F.coalesce("h_start", "end_ms").alias("b"))
    last = met.groupBy(*keys, "start_ms", "end_ms").agg(F.max("h_end").alias("a")).where("a is not null").select(*keys, "a", F.col("end_ms").alias("b"))
    return left.union(last).where(F.col("b") - F.col("a") >= least_ms).select(*keys, F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


def merge_hit_spans(hits: DataFrame, keys: list[str], pad_ms: int = 20_000, most_ms: int = 1_200_000) -> DataFrame:
    """Hits padded on both sides and merged, cut in time order where a key's total passes most_ms."""
    padded = hits.select(*keys, F.greatest(F.col("start_ms") - pad_ms, F.lit(0)).alias("start_ms"), (F.col("end_ms") + pad_ms).alias("end_ms"))
    told = running(union_spans(padded, keys), keys, ["start_ms"], time_bucket("start_ms"), {"_told": (F.col("end_ms") - F.col("start_ms"), "sum")})
    m = told.withColumn("_room", F.lit(most_ms) - F.col("_told")).where("_room > 1000")
    return m.select(*keys, "start_ms", F.least(F.col("end_ms"), F.col("start_ms") + F.col("_room")).alias("end_ms"))


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / BUCKET_MS), F.floor(F.col("end_ms") / BUCKET_MS))))


def overlap_join(left: DataFrame, right: DataFrame, key: str | list[str] = "video_id", inclusive: bool = False) -> DataFrame:
    """Pairs of left and right rows of a key (a column or several) that overlap: left's columns, and right's under the prefix r_.

    Both sides are dealt by key and time bucket, so a long key is split; a pair is kept in the bucket where its
    later start lies, so it comes once.
    """
    r = _bucketed(right).select(*(F.col(c).alias(f"r_{c}") for c in [*right.columns, "_bucket"]))
    later = F.floor(F.greatest("start_ms", "r_start_ms") / BUCKET_MS)
    if inclusive:
        over = (F.col("r_start_ms") <= F.col("end_ms")) & (F.col("r_end_ms") >= F.col("start_ms"))
    else:
        over = (F.col("r_start_ms") < F.col("end_ms")) & (F.col("r_end_ms") > F.col("start_ms"))
    keys = [key] if isinstance(key, str) else key
    met = _bucketed(left).join(r, [*(F.col(k) == F.col(f"r_{k}") for k in keys), F.col("_bucket") == F.col("r__bucket"), over])
    return met.where(F.col("_bucket") == later).drop("_bucket", "r__bucket", *(f"r_{k}" for k in keys))


def segments_in_spans(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments that touch a span of their video (ends included)."""
    met = overlap_join(segments.select("video_id", "position", "start_ms", "end_ms"), union_spans(spans, ["video_id"]), inclusive=True)
    return segments.join(met.select("video_id", "position").distinct(), ["video_id", "position"], "left_semi")


def time_spans(videos: DataFrame, chunk_ms: int = 120_000, least_ms: int = 50) -> DataFrame:
    """Chunks from done_ms to duration_ms: video_id, span_no, start_ms, length_ms; a rest under least_ms is none."""
    n = F.ceil((F.col("duration_ms") - F.col("done_ms") - least_ms + 1) / chunk_ms)
    v = videos.withColumn("_n", n).where("_n > 0").withColumn("span_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("done_ms") + F.col("span_no") * chunk_ms
    return v.select("video_id", "span_no", start.alias("start_ms"), F.least(F.lit(chunk_ms).cast("long"), F.col("duration_ms") - start).alias("length_ms"))


def diar_regions(videos: DataFrame, size_ms: int) -> DataFrame:
    """Diarization regions: chunks that look back min(20 s, a third), but for the first; under 0.3 s dropped."""
    back = min(20_000, size_ms // 3)
    t = time_spans(videos.withColumn("done_ms", F.lit(0).cast("long")), size_ms, 1)
    start = F.when(F.col("span_no") == 0, F.col("start_ms")).otherwise(F.greatest(F.col("start_ms") - back, F.lit(0)))
    return t.withColumn("_end", F.col("start_ms") + F.col("length_ms")).select("video_id", "span_no", start.alias("start_ms"), F.col("_end").alias("end_ms")).where("end_ms - start_ms >= 300")
