"""Streams that stop and go on: state that ends, windows that close, rows that are there once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import embedding, voices
from lectern.streaming import jobs

CHUNK = "video_id long, chunk_no long, end_ms long, turns array<struct<start_ms long, end_ms long, speaker string>>, voices map<string,array<double>>, created_at timestamp"
T0 = datetime(2024, 1, 1)


def chunks(spark, videos=5, n=6):
    rng = random.Random(2)
    rows = []
    for v in range(videos):
        for k in range(n):
            a = 10_000 * k
            turns, t = [], max(0, a - 3000)
            while t < a + 10_000:
                end = min(a + 10_000, t + rng.randint(500, 4000))
                turns.append((t, end, rng.choice("XYZ")))
                t = end
            known = {s: [rng.random(), rng.random(), rng.random()] for s in "XY"} if k % 3 else None
            rows.append((v, k, a + 10_000, turns, known, T0 + timedelta(minutes=k)))
    return spark.createDataFrame(rows, CHUNK)


def rows_of(df):
    return sorted(map(tuple, df.select("video_id", "start_ms", "end_ms", "speaker").collect()))


def test_turns_go_on_after_a_restart_and_the_state_ends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    c = chunks(spark)
    want = rows_of(voices.stitch_turns(c.drop("created_at")))
    stream = jobs.stitch_turns(spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    add = lambda df: df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.read.schema(stream.schema).parquet(f"{tmp_path}/rows").where("video_id < 100")
    add(c.where("chunk_no < 3"))
    jobs.started(stream, str(tmp_path))
    assert 0 < read().count() < len(want)
    add(c.where("chunk_no >= 2"))  # one of them again
    query = jobs.started(stream, str(tmp_path))
    assert rows_of(read()) == want
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] > 5
    for k in (1, 2):  # other videos, a day later: the first ones end, and what comes again of them is late
        add(spark.createDataFrame([(100 + k, 0, 10, [], None, T0 + timedelta(days=k))], CHUNK))
        query = jobs.started(stream, str(tmp_path))
    add(c.where("chunk_no = 5"))
    query = jobs.started(stream, str(tmp_path))
    assert rows_of(read()) == want and jobs.late_rows(query) == 5
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # the last video's


def test_windows_close_once_and_late_rows_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kinds = "id long, video_id long, kind string, created_at timestamp"
    at = lambda *minutes: [(i, 1, "a", T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    add = lambda rows: spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.event_counts(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), every="15 minutes")
    add(at(0, 20, 50, 100))
    query = jobs.started(stream, str(tmp_path))
    got = {(r.window_start - T0).total_seconds() / 60: r.n for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/rows").collect()}
    assert got == {-45: 1, -30: 2, -15: 2, 0: 3, 15: 2, 30: 1}  # ends of 90 minutes and less
    add(at(10, 600, 95))  # the first is in closed windows alone
    query = jobs.started(stream, str(tmp_path))
    assert jobs.late_rows(query) > 0
    after = {(r.window_start - T0).total_seconds() / 60: r.n for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/rows").collect()}
    assert after.items() >= got.items() and after[45] == 3 and after[90] == 2 and len(after) == 10
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # open windows only
    open_ = jobs.heartbeat_sessions(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"))
    assert [r.n for r in jobs.finished(open_).orderBy("session_start").collect()] == [3, 1, 2]  # 0, 10 and 20; 50; 95 and 100; that of 600 is open


@pytest.mark.parametrize("fails_at", [0, 1, 2])
def test_refill_after_a_failure(spark, tmp_path, monkeypatch, fails_at):
    schema = "video_id long, id long, text string, embedding array<float>"
    for k in range(3):
        spark.createDataFrame([(v, 10 * k + v, f"t{k} {v}", [1.0] if v == 3 else None) for v in range(4)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ready = {0}
    videos = lambda: spark.createDataFrame([(v, "ready" if v in ready else "queued") for v in range(4)], "video_id long, status string")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: jobs.refill(stream(), videos, "text", embedding.hashing_model(4), 4, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    read = lambda: sorted(r.id for r in jobs.refilled(spark, f"{tmp_path}/out", spark.createDataFrame([], schema).schema).collect())
    tries = []
    real = jobs.embed

    def broken(df, *rest):  # the rows are written, then the driver goes before the batch is noted as done
        out = real(df, *rest)
        tries.append(1)
        if len(tries) == fails_at + 1:
            out.write.mode("overwrite").parquet(f"{tmp_path}/out/rows/batch={fails_at}")
            raise RuntimeError("stopped")
        return out

    monkeypatch.setattr(jobs, "embed", broken)
    with pytest.raises(Exception):
        run()
    run()
    assert read() == [0, 10, 20]
    ready |= {1, 3}
    spark.createDataFrame([(0, 30, "x", None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert read() == [0, 1, 10, 11, 20, 21, 30]  # what waited came with the next batch; 2 isn't ready, 3 had vectors


def test_store_of_states_is_set_back(spark):
    before = spark.conf.get(jobs.STORE)
    with jobs.rocks(spark):
        assert spark.conf.get(jobs.STORE) == jobs.ROCKS
    assert spark.conf.get(jobs.STORE) == before
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_files_as_streams(spark, tmp_path, files):
    rows = spark.range(30).select((F.col("id") % 7).alias("a"), "id")
    rows.repartition(files).write.parquet(f"{tmp_path}/in/rows.parquet")
    rows.where("id < 3").write.parquet(f"{tmp_path}/in/others.parquet")
    got = jobs.finished(jobs.table_stream(spark, f"{tmp_path}/in", "rows"))
    assert sorted(r.id for r in got.collect()) == list(range(30))
