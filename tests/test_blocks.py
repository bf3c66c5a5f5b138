"""Operators that work in blocks, with blocks so small that many are needed, against plain loops."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import ann, folds, nearest, repair, scans, search, spans
from lectern.sources import buckets, transcripts


def vectors(spark, n=400, videos=3, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)), 2)
    rows = [(int(i % videos) if i >= hot else 0, i, x[i].tolist(), int(i % 4), f"t{i}") for i in range(n)]
    rows += [(0, n, None, 0, "none"), (0, n + 1, [0.0] * 6, 0, "zero"), (1, n + 2, [1.0, 2.0], 1, "short"), (1, n + 3, x[5].tolist(), 1, "copy"), (None, n + 4, x[5].tolist(), 1, "nowhere")]
    return spark.createDataFrame(rows, "video_id long, id long, embedding array<double>, group_no long, text string")


def plain_nearest(questions, rows, k, by_group):
    out = []
    for q in questions:
        if q.q_vec is None or q.video_id is None or not any(q.q_vec):
            continue
        met = {}
        for r in rows:
            if r.video_id == q.video_id and r.embedding is not None and any(r.embedding):
                a, b = np.array(q.q_vec), np.array(r.embedding)
                d = round(1 - float(a @ b) / float(np.sqrt((a @ a) * (b @ b))), 6) if len(a) == len(b) else 2.0
                met.setdefault(r.group_no if by_group else 0, []).append((d, r.id))
        for found in met.values():
            out += [(q.q_id, i, round(d, 5), place + 1) for place, (d, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sent", [100_000, 0])
@pytest.mark.parametrize("by_group", [False, True])
def test_nearest_in_blocks(spark, monkeypatch, sent, by_group):
    monkeypatch.setattr(nearest, "HELD", 64)
    monkeypatch.setattr(nearest, "BLOCK", 50)
    monkeypatch.setattr(nearest, "Q_BLOCK", 7)
    rows = vectors(spark, hot=200).repartition(4)
    q = rows.where("id % 9 = 0 or id > 398").select(F.col("id").alias("q_id"), "video_id", F.col("embedding").alias("q_vec"))
    got = nearest.nearest(q, rows, ["q_id", "group_no"] if by_group else ["q_id"], 5, most_sent=sent)
    assert set(got.columns) == {"q_id", "video_id", "id", "group_no", "text", "distance", "rank"}
    assert sorted((r.q_id, r.id, round(r.distance, 5), r["rank"]) for r in got.collect()) == plain_nearest(q.collect(), rows.collect(), 5, by_group)


def test_equal_distances_go_by_id(spark):
    rows = spark.createDataFrame([(1, i, [1.0, 0.0], 0, "") for i in (5, 3, 9, 1, 7)], "video_id long, id long, embedding array<double>, group_no long, text string").repartition(3)
    q = spark.createDataFrame([(0, 1, [2.0, 0.0])], "q_id long, video_id long, q_vec array<double>")
    assert [r.id for r in search.search_segments(q, rows, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert search.search_segments(q.where("false"), rows, 3).collect() == [] == search.search_segments(q, rows.where("false"), 3).collect()


def test_a_video_with_all_vectors_is_many_tasks(spark):
    rows = spark.range(2000).select(F.lit(1).cast("long").alias("video_id"), "id", F.array(F.rand(1), F.rand(2)).alias("embedding")).repartition(6)
    q = spark.createDataFrame([(0, 1, [2.0, 1.0])], "q_id long, video_id long, q_vec array<double>")
    met = nearest.nearest(q, rows, ["q_id"], 8)
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1].replace("Exchange RoundRobinPartitioning", "").replace("REPARTITION_BY_NUM", "")


def test_index_of_lists_finds_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    x = centre[rng.integers(0, 30, 3000)] + 0.35 * rng.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0])], "id long, embedding array<double>").repartition(4)
    q = rows.where("id % 20 = 0 and id < 5000").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_vec"))
    fitted = ann.fit(rows, sample=1000)
    index = ann.index_rows(rows, fitted).cache()
    assert index.count() == 3002 and index.where("list_no is null").count() == 2
    exact = {(r.q_id, r.id): r.distance for r in ann.search_exact(q, rows).collect()}
    got = {(r.q_id, r.id): r.distance for r in ann.search(index, q, rows, fitted).collect()}
    assert len(got) == len(exact) == 8 * 150
    assert all(abs(d - exact[p]) < 1e-6 for p, d in got.items() if p in exact)
    assert len(got.keys() & exact.keys()) / len(exact) >= 0.9


def test_recall_on_the_table(spark):
    from lectern.plans import registry

    sf = "/root/testdata/sf0.01"
    exact, got = ({(r.q_id, r.id) for r in registry.queries()[n](spark, sf).collect()} for n in ("search_corpus_exact", "search_corpus"))
    assert len(got & exact) / len(exact) >= 0.9


# ---- folds

def plain_parts(rows, cut):
    """no of each row: cut(origin, last, row)."""
    out, no, origin, last = [], 0, None, None
    for r in rows:
        if last is not None and cut(origin, last, r):
            no, origin = no + 1, r[0]
        elif last is None:
            origin = r[0]
        out.append(no)
        last = r
    return out


@pytest.mark.parametrize("block", [25, 1024])
def test_folds_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    rng = random.Random(block)
    data, t = [], 0
    for i in range(150):
        t += rng.choice([0, 0, 500, 1200, 3000, -2000 if i else 0])
        end = t + rng.choice([1000, 8000, 20_000, 70_000])
        data.append((max(t, 0), end, rng.choice("ab")))
        t = end
    steady = [(5000 * i, 5000 * i + 5000, "a") for i in range(400)]  # no pauses: each block depends on the one before
    rows = [(v, i, *r) for v, d in ((1, data), (2, steady), (3, data[:1])) for i, r in enumerate(d)]
    seg = spark.createDataFrame(rows, "video_id long, position long, start_ms long, end_ms long, speaker string")

    def cut(o, a, r):
        covered, gap = a[1] - o, r[0] - a[1]
        return covered >= 600_000 or covered >= 50_000 and (gap >= 2500 or gap >= 1000 and r[2] != a[2])

    told = folds.block_fold(seg, ["video_id"], "position", lambda s, r: (s["end_ms"] - s["origin"] >= 600_000) | (s["end_ms"] - s["origin"] >= 50_000) & ((r["start_ms"] - s["end_ms"] >= 2500) | (r["start_ms"] - s["end_ms"] >= 1000) & (r["speaker"] != s["speaker"])))
    got = {v: [r.no for r in told.where(f"video_id = {v}").orderBy("position").collect()] for v in (1, 2, 3)}
    assert got == {1: plain_parts(data, cut), 2: plain_parts(steady, cut), 3: [0]} and max(got[1]) > 5 and max(got[2]) == 3


@pytest.mark.parametrize("block", [9, 1024])
def test_pieces_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(60):
        t += rng.choice([0, 300, 4000])
        rows.append((1, i, t, t + rng.choice([0, 0, 100, 900, 6000, 40_000])))
        t = rows[-1][3]
    pieces, start, end = [], None, None
    for _, _, a, z in rows:
        if start is None or end - start == 0:
            start = a
        elif end - start > 200 and (end - start + z - end > 22_000 or end - start > 15_000):
            pieces.append((start, end))
            start = a
        end = z
    pieces.append((start, end))
    want = [(a + k * (z - a) / n, a + (k + 1) * (z - a) / n) for a, z in pieces if z - a > 200 for n in [(z - a) // 30_000 + 1 if z - a > 30_000 else 1] for k in range(n)]
    got = folds.pack_speech(spark.createDataFrame(rows, "video_id long, region_no long, start_ms long, end_ms long")).orderBy("start_ms").collect()
    assert np.allclose([(r.start_ms, r.end_ms) for r in got], want)


# ---- scans

@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_running_values_over_buckets(spark, monkeypatch, width):
    rng = random.Random(width)
    rows = [(rng.choice([1, 2, None]), rng.randint(-200, 900), i, rng.choice([None, rng.randint(0, 99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t long, i long, v long").repartition(3)
    for own in (False, True):
        got = scans.running(df, ["k"], ["t", "i"], scans.time_bucket("t", width), {"m": (F.col("v"), "max"), "s": (F.col("v"), "sum"), "l": (F.col("v"), "last")}, own)
        want = []
        for k in (1, 2, None):
            seen = []
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
                seen_now = [*seen, r[3]] if own else seen
                known = [v for v in seen_now if v is not None]
                want.append((*r, max(known, default=None), sum(known), known[-1] if known else None))
                seen.append(r[3])
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_spans_over_many_buckets(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), t := rng.randint(0, 9_000_000), t + rng.choice([0, 1000, 60_000, 2_000_000])) for _ in range(120)]
    rows += [(0, 100, 50_000_000)]
    df = spark.createDataFrame(rows, "video_id long, start_ms long, end_ms long")
    want = []
    for v in (0, 1):
        at = None
        for a, z in sorted(r[1:] for r in rows if r[0] == v):
            if at is None or a > at[1]:
                if at:
                    want.append((v, *at))
                at = [a, z]
            at[1] = max(at[1], z)
        want.append((v, *at))
    assert sorted(map(tuple, spans.union_spans(df, ["video_id"]).collect())) == sorted(want)
    at = spark.createDataFrame([(0, i, t) for i, t in enumerate([-5, 0, 150, 5_000_000, 90_000_000])], "video_id long, p_id long, at_ms long")
    seg = spark.createDataFrame([(0, 0, 300), (0, 1, 4_000_000), (0, 2, 4_000_100)], "video_id long, position long, start_ms long")
    assert [r.active for r in search.asof_segment(at, seg).orderBy("p_id").collect()] == [-1, -1, 0, 2, 2]


def test_words_move_with_their_segment(spark):
    seg = spark.createDataFrame([(1, 0, 100, 900, [("a", 100, 400), ("b", 500, 900)]), (1, 1, 0, 10, None)], "video_id long, chunk_no long, start_ms long, end_ms long, words array<struct<text string, start_ms long, end_ms long>>")
    chunks = spark.createDataFrame([(1, 0, 60_000), (1, 1, 120_000)], "video_id long, chunk_no long, start_ms long")
    got = repair.shift_times(seg, chunks).orderBy("chunk_no").collect()
    assert [tuple(w) for w in got[0].words] == [("a", 60_100, 60_400), ("b", 60_500, 60_900)] and got[1].words is None


# ---- the store

SEGMENT = "video_id long, position long, speaker string, text string"


def test_store_replaces_whole_keys(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(v, p, "AB"[p % 2], f"{v}/{p}") for v in range(300) for p in range(3)]
    seg = spark.createDataFrame(rows, SEGMENT)
    assert transcripts.write_transcript(seg, path, buckets=4) == 1
    store = transcripts.transcript_store(spark, path)
    assert len(list((tmp_path / "s").rglob("*.parquet"))) <= 2 * 4 * 4  # files follow buckets, not the 300 videos
    new = spark.createDataFrame([(7, 0, "C", "new"), (1000, 0, None, "more")], SEGMENT)
    videos = spark.createDataFrame([(7,), (8,), (1000,)], "video_id long")
    old = {b: f for b, f in store.manifest()["tables"]["segments"]["folders"].items()}
    assert transcripts.write_transcript(new, path, videos) == 2
    got = {(r.video_id, r.position): r.text for r in store.read("segments").collect()}
    assert got == {(v, p): t for v, p, _, t in rows if v not in (7, 8)} | {(7, 0): "new", (1000, 0): "more"}
    labels = sorted((r.video_id, r.label) for r in store.read("speakers").where("video_id in (6, 7, 8, 1000)").collect())
    assert labels == [(6, "A"), (6, "B"), (7, "C")]
    assert {(r.video_id, r.position) for r in store.read("segments", version=1).collect()} == {(v, p) for v, p, _, _ in rows}  # a reader of before
    touched = {str(r.b) for r in videos.select(store.bucket(4).alias("b")).collect()}
    now = store.manifest()["tables"]["segments"]["folders"]
    assert {b for b in now if now[b] == old.get(b)} == set(old) - touched
    assert store.vacuum(keep=1) > 0 and {(r.video_id, r.position): r.text for r in store.read("segments").collect()} == got


def test_store_of_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    seg = spark.createDataFrame([(1, 0, "A", "a")], SEGMENT)
    transcripts.write_transcript(seg, path, buckets=2)
    store = transcripts.transcript_store(spark, path)
    stale = store.manifest()
    transcripts.write_transcript(seg.withColumn("text", F.lit("b")), path)
    monkeypatch.setattr(store, "manifest", lambda version=None: stale)
    with pytest.raises(buckets.Conflict):
        store.replace(seg, {"segments": seg})
    monkeypatch.undo()
    assert [r.text for r in store.read("segments").collect()] == ["b"]
    with pytest.raises(ValueError):
        store.replace(seg.where("false"), {"segments": seg})
    transcripts.write_transcript(seg.where("false"), path, seg.select("video_id"))
    assert store.read("segments").collect() == [] == store.read("speakers").collect()
    assert store.read("none", schema="a int").collect() == []


def test_kernel_without_rows():
    none = nearest.matrices(pa.array([], pa.list_(pa.float64())))
    assert [len(x) for x in nearest.top_pairs(none, none, np.empty(0, np.int64), 3)] == [0, 0, 0]


def test_memory_of_a_block():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((3000, 16)), rng.standard_normal((10_000, 16))
    q, r = ([(np.arange(len(v)), v / np.linalg.norm(v, axis=1, keepdims=True))] for v in (x, y))
    tracemalloc.start()
    i, j, d = nearest.top_pairs(q, r, np.arange(len(y)), 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(i) == 3000 * 8  # before: 136 MB
    near = np.round(1 - q[0][1][:3] @ r[0][1].T, 6)
    assert [j[i == k].tolist() for k in range(3)] == [np.lexsort((np.arange(len(y)), v))[:8].tolist() for v in near]
