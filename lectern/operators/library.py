"""Reports and upkeep of the library: queue, stage times, formats, inventories, keys, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import squeezed, version_key
from ..sources.scratch import stored

# fixed values: stages in order, and the band of overall progress that each takes
BANDS = {"compressing": (0.0, 0.15), "storing": (0.15, 0.19), "transcribing": (0.19, 0.61), "diarizing": (0.61, 0.73), "merging": (0.73, 0.85), "correcting": (0.85, 0.92), "splitting": (0.92, 0.95), "embedding": (0.95, 0.96), "moments": (0.96, 0.98), "naming": (0.98, 0.985)}
# fixed values: file suffixes
VIDEO, AUDIO = ("mp4", "mkv", "mov", "avi", "webm", "m4v"), ("mp3", "m4a", "wav", "ogg", "flac", "aac", "opus")
# fixed values: codecs by how hard they are to decode; others count as UNKNOWN_COST
CODECS = (("avc", "avc1", "avc3", "h264"), ("vp8", "vp9", "vp09"), ("hev1", "hvc1", "hevc", "h265"), ("av01", "av1"))
UNKNOWN_COST = 2
# fixed values: a recording under this many seconds has all optional steps by default
SHORT_SEC = 90 * 60
#: Rows of stage times that a task adds up, on average.
ROWS_A_TASK = 500_000


def merge_stage_times(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Stage seconds with deltas: work stages add, fetching takes the larger."""
    total = F.when(F.col("stage") == "fetching", F.max("seconds")).otherwise(F.sum("seconds"))
    return base.select("video_id", "stage", "seconds").unionByName(delta.select("video_id", "stage", "seconds")).groupBy("video_id", "stage").agg(total.alias("seconds"))


def queue_place(videos: DataFrame) -> DataFrame:
    """Place of each video that isn't ready or failed, by creation and id; null for the others.

    Ranks without one task for all, or for a busy day: rows are dealt by ranges of (creation, id), sorted in their
    task, and the tasks' counts, a line each, are added up. The dealt rows are stored, as both steps need the same ranges.
    """
    active = videos.where("status not in ('ready', 'error')").select("video_id", "created_at")
    dealt = active.repartitionByRange("created_at", "video_id").sortWithinPartitions("created_at", "video_id")
    at = F.monotonically_increasing_id()  # the task's number, then 33 bits of the row's
    ranked = dealt.select("video_id", F.shiftright(at, 33).alias("_run"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
    ranked = stored(ranked, "queue-ranks")
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    places = ranked.join(F.broadcast(starts), "_run").select("video_id", (F.col("_start") + F.col("_in") + 1).cast("long").alias("place"))
    return videos.join(places, "video_id", "left")


def stage_durations(videos: DataFrame, stage_times: DataFrame, now: Column | None = None) -> DataFrame:
    """video_id, stage, seconds (> 0) of known videos, and processed_sec, their sum.

    With ``now``, the time of the stage that runs (from stage_started_at) and of fetching (from started_at) is added.
    Rows are dealt by video once: known videos, a stage's sum and the video's need the same exchange. The tasks are as many as the
    rows ask for (counted), so a task's memory doesn't grow with the input.
    """
    tasks = max(stage_times.sparkSession.sparkContext.defaultParallelism, -(-stage_times.count() // ROWS_A_TASK))
    rows = stage_times.select("video_id", "stage", "seconds").where("video_id is not null")
    if now is not None:
        since = lambda c: now.cast("double") - F.col(c).cast("double")
        work = [s for s in BANDS if s != "fetching"]
        live = videos.where(F.col("status").isin(*work) & F.col("stage_started_at").isNotNull()).select("video_id", F.col("status").alias("stage"), since("stage_started_at").alias("seconds"))
        fetched = videos.where("status = 'fetching' and started_at is not null").select("video_id", F.lit("fetching").alias("stage"), since("started_at").alias("seconds"))
        rows = rows.withColumn("seconds", F.col("seconds").cast("double")).unionByName(live).unionByName(fetched)
    # a line without stage and seconds says that a video is known; as a join, this would be an exchange and a sort of its own
    known = videos.select("video_id", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("stage", "seconds")), F.lit(True).alias("_known"))
    dealt = rows.withColumn("_known", F.lit(False)).unionByName(known).repartition(tasks, "video_id")
    s = dealt.groupBy("video_id", "stage").agg(F.sum("seconds").alias("seconds"), F.max("_known").alias("_known"))
    video = Window.partitionBy("video_id")
    s = s.withColumn("_known", F.max("_known").over(video)).withColumn("processed_sec", F.sum(F.when(F.col("seconds") > 0, F.col("seconds"))).over(video))
    return s.where("_known and seconds > 0").drop("_known")


def stage_flags(videos: DataFrame) -> DataFrame:
    """Optional steps; a missing flag means on."""
    on = lambda c: F.coalesce(c, F.lit(True))
    return videos.select("video_id", on("opt_diarize").alias("diarizing"), on("opt_merge").alias("merging"), on("opt_correct").alias("correcting"), on("opt_diarize").alias("naming"))


def default_flags(duration_sec: Column) -> Column:
    """The optional steps that a new recording is offered with: all on if its length is known and short, else all off."""
    on = F.coalesce((duration_sec > 0) & (duration_sec < SHORT_SEC), F.lit(False))
    return F.struct(on.alias("opt_diarize"), on.alias("opt_merge"), on.alias("opt_correct"))


def stages_in_order(durations: DataFrame) -> DataFrame:
    """video_id, stages (array of stage, seconds in the order in which stages run, others after them by name), processed_sec."""
    no = F.coalesce(F.create_map(*(F.lit(v) for k, s in enumerate(BANDS) for v in (s, k)))[F.col("stage")], F.lit(len(BANDS)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(no.alias("no"), "stage", "seconds"))), lambda x: F.struct(x["stage"].alias("stage"), x["seconds"].alias("seconds")))
    return durations.groupBy("video_id").agg(listed.alias("stages"), F.sum("seconds").alias("processed_sec"))


def format_bytes(formats: DataFrame) -> Column:
    """A format's size: told, else estimated, else from its bit rate (tbr, in kbit/s) and the duration (duration_sec); null if unknown."""
    has = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double")) if c in formats.columns else F.lit(None).cast("double")
    return F.coalesce(has("filesize"), has("filesize_approx"), has("tbr") * 1000 / 8 * has("duration_sec"))


def pick_format(formats: DataFrame) -> DataFrame:
    """One format a video: of those with a picture the nearest to 720 lines among those of 720 or more, if any; then fewer frames a
    second, an easier codec, fewer pixels, a smaller file, id. Without a picture the smallest that has sound.

    Formats (video_id, format_id, height, vcodec; width, acodec, fps, filesize, filesize_approx, tbr, duration_sec if known) with
    audio_only and needs_audio (a picture without sound). Formats with neither, or without an id, don't count.
    """
    given = lambda c, otherwise: F.col(c) if c in formats.columns else F.lit(otherwise)
    none = F.lit("none")
    vcodec = F.coalesce(F.nullif("vcodec", F.lit("")), none)
    acodec = F.coalesce(F.nullif("acodec", F.lit("")), none) if "acodec" in formats.columns else F.lit("unknown")
    height, width = F.coalesce("height", F.lit(0)), F.coalesce(given("width", 0), F.lit(0))
    picture = (height > 0) & (vcodec != "none")
    token = F.lower(F.substring_index(vcodec, ".", 1))
    cost = F.coalesce(*(F.when(token.isin(*names), k) for k, names in enumerate(CODECS)), F.lit(UNKNOWN_COST))
    fps = F.coalesce(F.when(given("fps", None) > 0, given("fps", None).cast("double")), F.lit(30.0))
    pixels = F.when((width > 0) & (height > 0), width.cast("long") * height).otherwise(height.cast("long") * height)
    size = format_bytes(formats)
    of_picture = F.when(picture, F.struct((height < 720).alias("low"), F.abs(height - 720).alias("far"), fps.alias("fps"), cost.alias("cost"), pixels.alias("pixels")))
    key = F.struct((~picture).alias("sound"), of_picture.alias("picture"), size.isNull().alias("unknown"), size.alias("size"), "format_id")
    chosen = F.min_by(F.struct(*[c for c in formats.columns if c != "video_id"], (~picture).alias("audio_only"), (picture & (acodec == "none")).alias("needs_audio")), key)
    usable = formats.where(F.col("format_id").isNotNull() & (F.col("format_id") != "") & (picture | (vcodec == "none") & (acodec != "none")))
    return usable.groupBy("video_id").agg(chosen.alias("f")).select("video_id", "f.*")


def media_inventory(files: DataFrame) -> DataFrame:
    """Files (path, length) by kind, with title and object key; empty and unknown ones are rejected."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(F.col("length") <= 0, "rejected").when(suffix.isin(*VIDEO), "video").when(suffix.isin(*AUDIO), "audio").otherwise("rejected")
    title = F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), 1, 180)
    return files.select("file_id", kind.alias("kind"), title.alias("title"), F.substring(name, 1, 240).alias("original_name"), F.when(kind == "video", F.concat(F.lit("videos/"), "file_id", F.lit(".mp4"))).when(kind == "audio", F.concat(F.lit("videos/"), "file_id", F.lit(".m4a"))).alias("object_key"))


def link_inventory(links: DataFrame) -> DataFrame:
    """Links with http(s) and a host, of 2000 characters at most, with a title."""
    u = links.withColumn("url", squeezed(F.col("url"))).where(F.col("url").rlike(r"^https?://[^/\s?#]+") & (F.length("url") <= 2000))
    host = F.regexp_extract("url", r"^https?://(?:[^@/]*@)?([^/:?#\s]+)", 1)
    return u.withColumn("title", F.substring(F.regexp_replace(host, r"^www\.", ""), 1, 180))


def keep_latest(events: DataFrame, n: int = 3000) -> DataFrame:
    """The latest events by id: n + 1 of them."""
    return events.orderBy(F.desc("id")).limit(n + 1)


def stage_fraction(rows: DataFrame) -> DataFrame:
    """percent: where overall (0..1) lies within its stage's band, 0..100; null for a stage without one."""
    edge = lambda k: F.create_map(*(F.lit(v) for s, b in BANDS.items() for v in (s, b[k])))[F.col("stage")]
    share = (F.col("overall") - edge(0)) / (edge(1) - edge(0))
    return rows.withColumn("percent", F.when(share.isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 100, 3)))


def load_seconds(videos: DataFrame, stages: DataFrame, now: Column | None = None) -> DataFrame:
    """Seconds a video took: its stages' sum, else processed_sec, else, with ``now``, those since started_at (0 at least), unless
    it is held, queued or not started; else null."""
    s = stages.groupBy("video_id").agg(F.sum("seconds").alias("_s"))
    joined = videos.join(s, "video_id", "left")
    known = [F.col("_s"), F.col("processed_sec")]
    if now is not None:
        waits = F.coalesce("held", F.lit(False)) | (F.col("status") == "queued")
        known.append(F.when(~waits & F.col("started_at").isNotNull(), F.greatest(F.lit(0.0), now.cast("double") - F.col("started_at").cast("double"))))
    return joined.select("video_id", F.coalesce(*known).alias("load_sec"))


def storage_usage(segments: DataFrame, vectors: DataFrame, entries: DataFrame | None = None, chats: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Bytes by video: text (UTF-8; segments, their words if any, chats with their citations), vectors (4 a number and 8), index
    (entries' texts and vectors), media and work (files: video_id, area, bytes), total. What a video lacks counts 0."""
    kinds = ("text_bytes", "vector_bytes", "index_bytes", "media_bytes", "work_bytes")
    size = lambda c: F.coalesce(F.octet_length(c).cast("long"), F.lit(0))
    wide = lambda c: F.when(F.size(c) > 0, (4 * F.size(c) + 8).cast("long")).otherwise(0)
    words = size(F.to_json("words")) if "words" in segments.columns else F.lit(0)
    parts = [segments.select("video_id", F.lit("text_bytes").alias("kind"), (size("text") + words).alias("n")), vectors.select("video_id", F.lit("vector_bytes"), wide("embedding"))]
    if entries is not None:
        parts.append(entries.select("video_id", F.lit("index_bytes"), size("text") + wide("embedding")))
    if chats is not None:
        parts.append(chats.select("video_id", F.lit("text_bytes"), size("content") + size("citations")))
    if files is not None:
        parts.append(files.select("video_id", F.when(F.col("area") == "media", "media_bytes").otherwise("work_bytes"), F.coalesce("bytes", F.lit(0).cast("long"))))
    rows = reduce(DataFrame.union, parts)
    total = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds]
    return rows.groupBy("video_id").agg(*total, F.sum("n").alias("total_bytes"))


def stale_tasks(tasks: DataFrame, videos: DataFrame, now: Column, limit_sec: int = 900) -> DataFrame:
    """tasks (task_id, video_id, status, heartbeat_at) with gone (its video is no more), held, heartbeat_age and stale: runs, but
    hasn't been heard of for ``limit_sec``, though its video is there and not held."""
    v = videos.select("video_id", F.coalesce("held", F.lit(False)).alias("_held"))
    t = tasks.join(v, "video_id", "left").withColumn("gone", F.col("video_id").isNotNull() & F.col("_held").isNull()).withColumn("held", F.coalesce("_held", F.lit(False)))
    t = t.withColumn("heartbeat_age", now.cast("double") - F.col("heartbeat_at").cast("double")).drop("_held")
    stale = (F.col("status") == "running") & (F.col("heartbeat_age") > limit_sec) & ~F.col("gone") & ~F.col("held")
    return t.withColumn("stale", F.coalesce(stale, F.lit(False)))


def pending_links(videos: DataFrame) -> DataFrame:
    """Links that are still fetched and not held: video_id, source_url, created_at."""
    return videos.where("status = 'fetching' and source_url is not null and not coalesce(held, false)").select("video_id", "source_url", "created_at")


def latest_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows (version) of each key the one with the greatest version, by its numbers."""
    return rows.groupBy(*keys).agg(F.max_by("version", F.struct(version_key(F.col("version")), "version")).alias("version"))


def uniqueness_report(segments: DataFrame, speakers: DataFrame, indexes: DataFrame, videos: DataFrame) -> DataFrame:
    """Keys that occur more than once though the model says once: rule, key, n."""
    rules = (
        (segments, ["video_id", "position"], "segment position"), (speakers, ["video_id", "label"], "speaker label"), (indexes, ["video_id", "name"], "index name"),
        (indexes.where("kind = 'moments'"), ["video_id"], "one moments index"), (videos.where("status = 'fetching'"), ["source_url"], "one live fetch"),
    )
    return reduce(DataFrame.union, (repeated_keys(t.where(" and ".join(f"{k} is not null" for k in keys)), keys, rule) for t, keys, rule in rules))


def index_catalog(indexes: DataFrame) -> DataFrame:
    """Indexes shown for a video: moments first, then by creation; those of agents are hidden."""
    key = F.when(F.col("kind") == "moments", 0).otherwise(1)
    return indexes.where("kind <> 'agent'").withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(key, "created_at", "index_id")))


def pending_builds(indexes: DataFrame, videos: DataFrame) -> DataFrame:
    """Indexes still building for ready videos."""
    return indexes.where("status = 'building'").join(videos.where("status = 'ready'").select("video_id"), "video_id", "left_semi")


def purge(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """A table without the rows of deleted videos."""
    return table.join(deleted.select("video_id").distinct(), "video_id", "left_anti")


def pending_pieces(pieces: DataFrame, saved: DataFrame) -> DataFrame:
    """Pieces that aren't stored yet."""
    return pieces.join(saved.select("video_id", "piece_no"), ["video_id", "piece_no"], "left_anti")


def resume_prefix(pieces: DataFrame, files: DataFrame, chunk_ms: int) -> DataFrame:
    """For each video the number of leading pieces whose files exist and aren't empty, and done_ms."""
    ok = files.where("length > 0").select("path", F.lit(True).alias("_ok"))
    p = pieces.join(ok, "path", "left")
    kept = F.coalesce(F.min(F.when(F.col("_ok").isNull(), F.col("piece_no"))), F.count("*"))
    g = p.groupBy("video_id").agg(kept.alias("kept"), F.count("*").alias("_n"), F.max("done_ms").alias("_done"))
    return g.select("video_id", "kept", F.when(F.col("kept") < F.col("_n"), F.col("kept") * chunk_ms).otherwise(F.col("_done")).alias("done_ms"))


def repeated_keys(table: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once: rule, key, n."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("key"), "n")


def missing_embeddings(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Segments of ready videos without a vector; embed_text ("who: text") where they have speaker_name and text."""
    rows = segments.where("embedding is null").join(videos.where("status = 'ready'").select("video_id"), "video_id", "left_semi")
    if {"speaker_name", "text"} <= set(segments.columns):
        rows = rows.withColumn("embed_text", F.concat("speaker_name", F.lit(": "), "text"))
    return rows


def missing_entry_embeddings(entries: DataFrame, indexes: DataFrame) -> DataFrame:
    """Entries of ready indexes without a vector, with embed_text."""
    ready = indexes.where("status = 'ready'").select("index_id")
    return entries.where("embedding is null").join(ready, "index_id", "left_semi").withColumn("embed_text", F.col("text"))


def recent_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each dialogue."""
    return messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= n)


def needs_summary(messages: DataFrame, limit: int = 6000, tail: int = 4) -> DataFrame:
    """Whether more than ``limit`` characters lie before a dialogue's last ``tail`` messages."""
    m = messages.withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return m.groupBy("conv_id").agg((F.coalesce(F.sum(F.when(F.col("_back") > tail, F.length("text"))), F.lit(0)) > limit).alias("needs_summary"))


def event_counts(events: DataFrame, width: str = "1 hour", every: str | None = None) -> DataFrame:
    """Events by kind and window of time, sliding by ``every`` if given; the same on a stream with a watermark."""
    return events.groupBy(F.window("created_at", width, every or width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def heartbeat_sessions(events: DataFrame, gap: str = "900 seconds") -> DataFrame:
    """Work sessions that a silence of ``gap`` ends: video_id, session_start, n; the same on a stream with a watermark."""
    return events.groupBy("video_id", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("n")).select("video_id", F.col("w.start").alias("session_start"), "n")
