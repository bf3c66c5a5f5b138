"""The model's tables from the driver's, in integer milliseconds, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, position, id, speaker, text, start_ms, end_ms."""
    before = Window.partitionBy("video_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("position"), "role", "text")
    c = c.withColumn("dur", F.greatest(F.lit(1000), F.length("text") * 66).cast("long")).withColumn("gap", F.col("position") % 4 * 1000)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0)).cast("long")
    speaker = F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01")
    return c.withColumn("start_ms", start).select("video_id", "position", (F.col("video_id") * 1000 + F.col("position")).alias("id"), speaker.alias("speaker"), "text", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of long videos: ten conversations each, one after the other."""
    c = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 10).alias("video_id"), (F.col("conv_id") % 10 * 8 + F.col("turn")).alias("position"), "role", "text")
    c = c.withColumn("dur", F.greatest(F.lit(1000), F.length("text") * 66).cast("long"))
    before = Window.partitionBy("video_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("position") % 4 * 1000).over(before), F.lit(0)).cast("long")
    speaker = F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01")
    return c.withColumn("start_ms", start).select("video_id", "position", (F.col("video_id") * 1000 + F.col("position")).alias("id"), speaker.alias("speaker"), "text", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, label, name: names for even videos only."""
    v = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id")).distinct().where("video_id % 2 = 0")
    return v.select("video_id", F.explode(F.array(F.struct(F.lit("SPEAKER_00").alias("label"), F.lit("Гость").alias("name")), F.struct(F.lit("SPEAKER_01").alias("label"), F.lit("Ведущий").alias("name")))).alias("s")).select("video_id", "s.label", "s.name")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 20 s for each video: turn_no, start_ms, end_ms, speaker T0..T2, chunk_no."""
    last = segments(spark, sf_dir).groupBy("video_id").agg(F.max("end_ms").alias("last"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 20000)))
    t = last.select("video_id", k.alias("turn_no"))
    return t.select("video_id", "turn_no", (F.col("turn_no") * 20000).alias("start_ms"), (F.col("turn_no") * 20000 + 20000).alias("end_ms"), F.concat(F.lit("T"), (F.col("turn_no") % 3).cast("string")).alias("speaker"), F.floor(F.col("turn_no") / 5).alias("chunk_no"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, id, embedding (null for every 17th), start_ms, end_ms, speaker, text."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 17 != 0, F.col("embedding")).alias("embedding"), (F.col("vec_id") * 5000).alias("start_ms"), (F.col("vec_id") * 5000 + 4000).alias("end_ms"), F.concat(F.lit("SPEAKER_0"), (F.col("vec_id") % 2).cast("string")).alias("speaker"), F.concat(F.lit('Ответ "'), F.col("vec_id").cast("string"), F.lit('"\nи дальше')).alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0")
    return e.select(F.col("vec_id").alias("q_id"), F.col("label").cast("long").alias("video_id"), F.col("embedding").alias("q_vec"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "queued").otherwise("transcribing")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("video_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), (k % 11 == 0).alias("held"), F.when(k % 7 != 0, k % 2 == 0).alias("opt_diarize"),
        F.when(k % 7 != 1, k % 3 == 0).alias("opt_merge"), F.when(k % 7 != 2, k % 5 == 0).alias("opt_correct"), F.when(k % 13 != 0, F.col("o_totalprice")).alias("processed_sec"),
        F.when(k % 3 != 0, F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=k % 1000)).alias("stage_started_at"), F.when(k % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("started_at"),
        F.concat(F.lit("https://a.example/"), (k % 500).cast("string")).alias("source_url"),
    )


ACTIVE = ("compressing", "storing", "transcribing", "diarizing", "merging", "correcting", "fetching")


def stage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, stage, seconds: a log of deltas."""
    stage = F.element_at(F.array(*map(F.lit, ACTIVE)), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), stage.alias("stage"), F.col("l_quantity").alias("seconds"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.concat_ws("-", p, s, F.col("l_linenumber")).alias("format_id"), at((360, 480, 720, 1080, 1440), p % 5).alias("height"),
        at((30.0, 60.0), s % 2).alias("fps"), at(("avc1", "vp9", "av01", "hev1"), s % 4).alias("vcodec"), F.col("l_extendedprice").alias("filesize"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))


SEGMENTS = """seg AS (SELECT conv_id AS video_id, turn AS position, conv_id*1000+turn AS id, text,
  CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' END AS speaker,
  CAST(coalesce(sum(greatest(1000, length(text)*66) + turn%4*1000) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(coalesce(sum(greatest(1000, length(text)*66) + turn%4*1000) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + greatest(1000, length(text)*66) AS BIGINT) AS end_ms
  FROM conversations)"""
EPISODES = """eps AS (SELECT conv_id//10 AS video_id, conv_id%10*8+turn AS position, text, greatest(1000, length(text)*66) AS dur, CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' END AS speaker FROM conversations),
ept AS (SELECT *, CAST(coalesce(sum(dur + position%4*1000) OVER (PARTITION BY video_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM eps),
ep AS (SELECT video_id, position, video_id*1000+position AS id, speaker, text, start_ms, start_ms+dur AS end_ms FROM ept)"""
SPEAKERS = """spk AS (SELECT v.video_id, l.label, l.name FROM (SELECT DISTINCT conv_id AS video_id FROM conversations WHERE conv_id%2=0) v,
  (VALUES ('SPEAKER_00','Гость'),('SPEAKER_01','Ведущий')) l(label, name))"""
TURNS = """trn AS (SELECT video_id, k AS turn_no, k*20000 AS start_ms, k*20000+20000 AS end_ms, 'T' || (k%3) AS speaker, k//5 AS chunk_no
  FROM (SELECT video_id, unnest(generate_series(0, max(end_ms)//20000)) AS k FROM seg GROUP BY video_id))"""
VECTORS = """vec AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id AS id, CASE WHEN vec_id%17<>0 THEN CAST(embedding AS DOUBLE[]) END AS embedding, vec_id*5000 AS start_ms, vec_id*5000+4000 AS end_ms, 'SPEAKER_0' || (vec_id%2) AS speaker, 'Ответ "' || vec_id || '"' || chr(10) || 'и дальше' AS text FROM embeddings),
q AS (SELECT vec_id AS q_id, CAST(label AS BIGINT) AS video_id, CAST(embedding AS DOUBLE[]) AS q_vec FROM embeddings WHERE vec_id%10=0)"""
VIDEOS = """vid AS (SELECT o_orderkey AS video_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'queued' ELSE 'transcribing' END AS status, o_orderkey%11=0 AS held,
  CASE WHEN o_orderkey%7<>0 THEN o_orderkey%2=0 END AS opt_diarize, CASE WHEN o_orderkey%7<>1 THEN o_orderkey%3=0 END AS opt_merge, CASE WHEN o_orderkey%7<>2 THEN o_orderkey%5=0 END AS opt_correct,
  CASE WHEN o_orderkey%13<>0 THEN o_totalprice END AS processed_sec,
  CASE WHEN o_orderkey%3<>0 THEN CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey%1000) END AS stage_started_at, CASE WHEN o_orderkey%5<>0 THEN CAST(o_orderdate AS TIMESTAMP) END AS started_at, 'https://a.example/' || (o_orderkey%500) AS source_url FROM orders)"""
DELTAS = f"""del AS (SELECT l_orderkey AS video_id, CAST({list(ACTIVE)} AS VARCHAR[])[l_linenumber] AS stage, l_quantity AS seconds FROM lineitem)"""
FORMATS = """fmt AS (SELECT l_orderkey AS video_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS format_id, [360,480,720,1080,1440][l_partkey%5+1] AS height, [30.0,60.0][l_suppkey%2+1] AS fps, ['avc1','vp9','av01','hev1'][l_suppkey%4+1] AS vcodec, l_extendedprice AS filesize FROM lineitem)"""
