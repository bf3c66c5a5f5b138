"""Every query that has SQL against DuckDB, and literal cases of the functions."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as f
from lectern.operators import repair, spans, speakers
from lectern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    mine = sorted((tuple(map(plain, r)) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert mine == theirs


def values(spark, column, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_clock_marks(spark):
    assert values(spark, f.parse_clock, ["5:59", "1:02:30", "125:00", "@5:59", "[5:59", " 6:27] ", "12,5"]) == [359, 3750, 7500, 359, 359, 387, 12.5]
    assert values(spark, f.parse_clock, ["", "минута", "5:xx", "1:2:3:4", "-5", "true"]) == [None] * 6
    assert values(spark, lambda c: f.clock(c.cast("double")), ["0", "65.9", "3725", "-3"]) == ["0:00", "1:05", "1:02:05", "0:00"]
    got = values(spark, f.parse_range, ["@0:45-@2:00:05", "5:00 – 12:30", "5:00-end", "9:00-1:00", "x"])
    assert [None if g is None else tuple(g) for g in got] == [(45, 7205), (300, 750), (300, None), None, None]
    assert values(spark, f.seek_marks, ["a [1:00–1:20] b"]) == ["a @1:00-1:20 b"]


def test_words_and_units(spark):
    assert values(spark, f.yes_no, ["ОТВЕТ: ДА", "no.", "maybe"]) == [True, False, None]
    assert values(spark, f.sentence_closed, ["Да.", "Да.»", "and-", "so"]) == [True, True, False, False]
    assert values(spark, lambda c: f.human_bytes(c.cast("long")), ["512", "1536", "20971520"]) == ["512 Б", "1,5 КБ", "20 МБ"]
    assert values(spark, f.version_key, ["2025.10.14", "2025-9-1"]) == [[2025, 10, 14], [2025, 9, 1]]
    assert values(spark, f.version_key, ["20261128123456.1", "1a2", "v..x-3", "", "9" * 50]) == [[20261128123456, 1], [12], [3], [], [int("9" * 38)]]
    assert values(spark, f.query_terms, ["Cats and dogs CATS бегают четыре пять раз"]) == [["Cats", "dogs", "бегают", "четыре"]]
    assert values(spark, f.plain_text, ["**b** and [x](http://a) `c`\n# h"]) == ["b and x c\nh"]
    assert values(spark, lambda c: repair.restarted_thought(c, F.lit("Разработчик и")), ["это разработка", "это тест"]) == [True, False]


def test_vectors_as_text(spark):
    r = spark.sql("select array(0.1D, 0.25D) as v").select(f.vec_to_text(F.col("v")).alias("t")).withColumn("b", f.text_to_vec(F.col("t"))).first()
    assert r.t == "[0.1000000,0.2500000]" and r.b == [0.1, 0.25]


def test_spans(spark):
    hits = spark.createDataFrame([(1, 60_000, 80_000), (1, 90_000, 100_000)], "video_id long, start_ms long, end_ms long")
    assert [tuple(r) for r in spans.merge_hit_spans(hits, ["video_id"]).collect()] == [(1, 40_000, 120_000)]
    v = spark.createDataFrame([(1, 250_000, 0), (2, 250_000, 120_000)], "video_id long, duration_ms long, done_ms long")
    assert sorted(tuple(r)[2:] for r in spans.time_spans(v).where("video_id = 1").collect()) == [(0, 120_000), (120_000, 120_000), (240_000, 10_000)]
    assert spans.time_spans(v).where("video_id = 2").count() == 2


def test_ties_go_to_the_first_turn(spark):
    seg = spark.createDataFrame([(1, 0, None, 0, 10_000), (1, 1, None, 200_000, 210_000)], "video_id long, position int, speaker string, start_ms long, end_ms long")
    turns = spark.createDataFrame([(1, 0, "A", 0, 5_000), (1, 1, "B", 5_000, 10_000)], "video_id long, turn_no long, speaker string, start_ms long, end_ms long")
    assert {r.position: r.speaker for r in speakers.assign_speakers(seg, turns).collect()} == {0: "A", 1: None}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_sizes_beyond_a_long(spark, tmp_path):
    spark.range(139_999, 140_001).withColumnRenamed("id", "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r["size"] for r in registry.queries()["human_bytes_large"](spark, str(tmp_path)).collect()}
    assert got == {k: f"{round(k**3 * 4099 / 1024**3)} ГБ" for k in (139_999, 140_000)}


def test_sizes_of_the_first_units(spark, tmp_path):
    spark.range(28_339, 28_341).withColumnRenamed("id", "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r["size"] for r in registry.queries()["human_bytes"](spark, str(tmp_path)).collect()}
    assert got == {28_339: "1024 КБ", 28_340: "?"}
