"""Folds, topics, scopes, corrections and streams: literal cases, and brute force over tables."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import cards, embedding, fixes, folds, library, speakers, voices
from lectern.plans import timeline
from lectern.sources import bindings as b
from lectern.sources import transcripts
from lectern.streaming import jobs

SF = "/root/testdata/sf0.001"
SEGMENT = "video_id long, position long, start_ms long, end_ms long, speaker string, text string"


def segments(spark, rows):
    """(start, end[, speaker[, text]]) in seconds, of one video."""
    return spark.createDataFrame([(1, i, int(r[0] * 1000), int(r[1] * 1000), r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "x") for i, r in enumerate(rows)], SEGMENT)


def parts(df, *cols):
    return len({tuple(r) for r in df.select(*cols).collect()})


def test_chapters(spark):
    many = lambda rows: parts(folds.topic_chapters(segments(spark, rows)), "chapter_no")
    assert many([(0, 30), (30, 62), (66, 130)]) == 2
    assert many([(0, 20), (24, 40)]) == 1
    assert many([(0, 60), (63, 80)]) == 1  # a short tail goes back
    assert many([(0, 70, "a"), (71.2, 130, "b")]) == 2
    assert many([(30 * i, 30 * i + 30) for i in range(24)]) >= 2
    assert many([]) == 0


def test_atoms_and_topics(spark):
    a = folds.topic_atoms(segments(spark, [(40 * i, 40 * i + 40) for i in range(12)])).groupBy("chapter_no", "atom_no").agg((F.max("end_ms") - F.min("start_ms")).alias("ms")).collect()
    assert len(a) >= 3 and max(r.ms for r in a) <= 190_000
    atoms = spark.createDataFrame([(1, i, i * 100_000, i * 100_000 + 100_000) for i in range(5)], "video_id long, atom_no long, start_ms long, end_ms long")
    verdicts = spark.createDataFrame([(1, i, i == 0) for i in range(5)], "video_id long, atom_no long, is_start boolean")
    assert [r.topic_no for r in folds.topic_groups(atoms, verdicts).orderBy("atom_no").collect()] == [0, 0, 0, 1, 1]
    three = folds.topic_groups(atoms.where("atom_no < 3"), verdicts.where("atom_no < 0")).orderBy("atom_no").collect()
    assert [r.topic_no for r in three] == [0, 1, 2]


def test_windows(spark):
    w = folds.windows(segments(spark, [(10 * i, 10 * i + 10, None, "ш" * 84) for i in range(120)]), 3000).collect()
    assert len({r.window_no for r in w}) >= 3
    assert sorted(r.position for r in w if not r.carried) == list(range(120))
    for n in {r.window_no for r in w} - {0}:
        before = {r.position for r in w if r.window_no == n - 1}
        assert {r.position for r in w if r.window_no == n and r.carried} == set(sorted(before)[-3:])
    far = folds.windows(segments(spark, [(0, 10), (700, 710)])).collect()
    assert [(r.window_no, r.carried) for r in far] == [(0, False), (1, False)]


def test_pack_speech(spark):
    rows = [(0, 10), (11, 20), (21, 30), (30, 30.1), (100, 170)]
    r = spark.createDataFrame([(1, i, int(a * 1000), int(z * 1000)) for i, (a, z) in enumerate(rows)], "video_id long, region_no long, start_ms long, end_ms long")
    got = [(p.start_ms, p.end_ms) for p in folds.pack_speech(r).orderBy("piece_no", "part_no").collect()]
    assert got[:2] == [(0, 20_000), (21_000, 30_100)]
    assert np.allclose(got[2:], [(100_000 + k * 70_000 / 3, 100_000 + (k + 1) * 70_000 / 3) for k in range(3)])


def greedy(entries, same):
    """(id, leader id) by the plain loop."""
    groups, found = [], {}
    for e in sorted(entries, key=lambda e: (e.start_ms, e.end_ms, e.id)):
        best, score = None, same
        for g in groups:
            like = float(np.dot(e.embedding, g.embedding))
            if like >= score:
                best, score = g, like
        if best is None:
            groups.append(e)
            best = e
        found[e.id] = best.id
    return found


def test_fold_repeats(spark):
    rows = [(7, 1, 10_000, 20_000, [1.0, 0.0], "коротко"), (7, 2, 600_000, 610_000, [0.999, 0.0447], "гораздо длиннее"), (7, 3, 30_000, 40_000, [0.0, 1.0], "иное"), (7, 4, 50_000, 60_000, [0.3, 0.954], "почти"), (7, 5, 1, 2, None, "без вектора")]
    e = spark.createDataFrame(rows, "index_id long, id long, start_ms long, end_ms long, embedding array<double>, text string")
    none = spark.createDataFrame([], "index_id long, id long, text string")
    got = {r.id: (r.text, r.members) for r in folds.fold_repeats(e, none).collect()}
    assert got == {1: ("гораздо длиннее Звучит: 0:10, 10:00.", 2), 3: ("иное", 1), 4: ("почти", 1), 5: ("без вектора", 1)}
    said = spark.createDataFrame([(7, 3, "общее")], "index_id long, id long, text string")
    got = {r.id: (r.text, r.changed) for r in folds.fold_repeats(e, said).collect()}
    assert got[3] == ("общее", True) and 4 not in got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_fold_repeats_against_the_plain_loop(spark):
    e = b.vectors(spark, SF).where("embedding is not null").select(F.col("video_id").alias("index_id"), "id", "start_ms", "end_ms", F.col("embedding").cast("array<double>").alias("embedding"), F.lit("п").alias("text"))
    want = {}
    for index in {r.index_id for r in e.select("index_id").collect()}:
        for leader in greedy(e.where(F.col("index_id") == index).collect(), 0.3).values():
            want[leader] = want.get(leader, 0) + 1
    got = {r.id: r.members for r in folds.fold_repeats(e, e.select("index_id", "id", F.lit("вместе").alias("text")), same=0.3, twin=2.0).collect()}
    assert got == want and max(want.values()) > 1


def chunk(no, end, turns, known=None):
    return (1, no, end * 1000, [(int(a * 1000), int(z * 1000), s) for a, z, s in turns], known)


CHUNK = "video_id long, chunk_no long, end_ms long, turns array<struct<start_ms long, end_ms long, speaker string>>, voices map<string,array<double>>"
CASES = [
    ([chunk(0, 10, [(0, 10, "A")]), chunk(1, 20, [(8, 15, "X"), (15, 20, "Y")])], [(0, 10_000, "SPEAKER_00"), (10_000, 15_000, "SPEAKER_00"), (15_000, 20_000, "SPEAKER_01")]),
    ([chunk(0, 10, [(0, 5, "A"), (5, 10, "B")], {"A": [1.0, 0.0], "B": [0.0, 1.0]}), chunk(1, 20, [(8, 12, "X"), (12, 20, "Y")], {"X": [0.0, 2.0], "Y": [0.9, 0.43]})], [(0, 5000, "SPEAKER_00"), (5000, 10_000, "SPEAKER_01"), (10_000, 12_000, "SPEAKER_01"), (12_000, 20_000, "SPEAKER_00")]),
    ([chunk(0, 10, [(0, 10, "A")], {"A": [1.0, 0.0]}), chunk(1, 20, [(12, 20, "Z")], {"Z": [0.0, 1.0]})], [(0, 10_000, "SPEAKER_00"), (12_000, 20_000, "SPEAKER_01")]),
    ([chunk(0, 10, [(0, 10, "A")]), chunk(1, 10, [(0, 10, "B")])], [(0, 10_000, "SPEAKER_00")]),
]


@pytest.mark.parametrize("chunks, want", CASES)
def test_stitch_turns(spark, chunks, want):
    got = voices.stitch_turns(spark.createDataFrame(chunks, CHUNK)).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.speaker) for r in got] == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stitch_stream_equals_batch(spark, tmp_path):
    chunks = timeline._chunks(spark, SF)
    for part in range(2):  # two files, so two micro-batches; the first comes again
        chunks.where(f"chunk_no >= {3 * part} and (chunk_no < 3 or {part} = 1)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    chunks.where("chunk_no < 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.finished(jobs.stitch_turns(stream))
    order = lambda df: sorted(map(tuple, df.select("video_id", "start_ms", "end_ms", "speaker").collect()))
    assert order(got) == order(voices.stitch_turns(chunks))


def test_refill(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "раз два", None), (1, 2, "три", [1.0]), (1, 3, None, None)], "video_id long, id long, text string, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    videos = spark.createDataFrame([(1, "ready")], "video_id long, status string")
    jobs.refill(stream, lambda: videos, "text", embedding.hashing_model(8), 8, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.id: r.embedding for r in jobs.refilled(spark, f"{tmp_path}/out", rows.schema).collect()}
    assert set(got) == {1, 3} and got[3] is None and abs(np.linalg.norm(got[1]) - 1) < 1e-6


def test_embed_refuses_other_lengths(spark):
    with pytest.raises(Exception, match="model gave"):
        embedding.embed(spark.createDataFrame([("a",)], "text string"), "text", embedding.hashing_model(4), 8).collect()


PLACE = "q_id long, video_id long, role string, start_ms long, end_ms long"


@pytest.mark.parametrize("places, want", [
    ([("skip", 0, 30)], [(30, 60)]),
    ([("skip", 10, 20)], [(0, 10), (20, 60)]),
    ([("only", 0, 30), ("skip", 10, 15)], [(0, 10), (15, 30)]),
    ([("skip", 0, None)], []),
    ([("only", 50, 70)], [(50, 60)]),
    ([("only", 70, 80)], []),
])
def test_resolve_places(spark, places, want):
    m = lambda x: None if x is None else x * 60_000
    p = spark.createDataFrame([(1, 1, role, m(a), m(z)) for role, a, z in places], PLACE)
    v = spark.createDataFrame([(1, 3_600_000)], "video_id long, duration_ms long")
    got = sorted((r.start_ms // 60_000, r.end_ms // 60_000) for r in cards.resolve_places(p, v).where("kind = 'range'").collect())
    assert got == want


def test_index_spans(spark):
    span = "q_id long, start_ms long, end_ms long"
    hits, area = spark.createDataFrame([(q, a * 1000, z * 1000) for q in (1, 2, 4) for a, z in ((60, 80), (2500, 2520))] + [(3, 2_500_000, 2_520_000)], span), spark.createDataFrame([(q, 22_000, 1_866_000) for q in (1, 2, 3)], span)
    scopes = spark.createDataFrame([(1, "found"), (2, "all"), (3, "found"), (4, "found"), (5, "found"), (6, "all")], "q_id long, scope string")
    got = sorted(tuple(r) for r in cards.index_spans(scopes, hits, area).collect())
    assert got == [(1, 40_000, 100_000), (2, 22_000, 1_866_000), (3, 22_000, 1_866_000), (4, 40_000, 100_000), (4, 2_480_000, 2_540_000)]


def test_current_sentence(spark):
    p = spark.createDataFrame([(0, 10_000, "Раз. Два! Три?", at) for at in (-5, 0, 4000, 9999, 50_000)] + [(0, 1, "", 0)], "start_ms long, end_ms long, text string, at_ms long")
    assert [r.sentence for r in cards.current_sentence(p).collect()] == ["Раз.", "Раз.", "Два!", "Три?", "Три?", ""]
    words = [(w, 100 * i) for i, w in enumerate("Раз и. Два! Три и".split())]
    t = spark.createDataFrame([(0, 500, "Раз и. Два! Три и", at, words) for at in (-50, 0, 169, 170, 250, 300, 900)] + [(0, 9, "Да.", 1, [])], "start_ms long, end_ms long, text string, at_ms long, words array<struct<text string, start_ms long>>")
    assert [r.sentence for r in cards.current_sentence(t).collect()] == ["Раз и.", "Раз и.", "Раз и.", "Два!", "Два!", "Три и", "Три и", "Да."]


def test_model_answers(spark):
    df = spark.createDataFrame([('```json\n{"a": "1", "b": [2]}\n``` да', "вот [1, 3] всё"), ("нет", "пусто")], "x string, y string")
    got = df.select(cards.parse_object(F.col("x")).alias("o"), cards.parse_numbers(F.col("y")).alias("n")).collect()
    assert got[0].o == {"a": "1", "b": "[2]"} and got[0].n == [1, 3] and not got[1].o and not got[1].n


def test_fixes(spark):
    s = spark.createDataFrame([(1, "ну Какое-то окно, докер окно", ["ну", "Какое-то", "окно,", "докер", "окно"])], "id long, text string, words array<string>")
    a = spark.createDataFrame([(1, "Правки:\n1 Какое-то -> какое-то\n`4 окно Окно`\n9 x -> X\n0 да -> Да\n2: окно, => полка\nНЕТ")], "key long, answer string")
    fixed = fixes.apply_case_fixes(s, fixes.parse_fixes(a)).collect()[0]
    assert fixed.text == "ну какое-то окно, докер Окно" and fixed.words == ["ну", "какое-то", "окно,", "докер", "Окно"]
    latin = spark.createDataFrame([(1, 0, 3, "докер", "Docker"), (1, 1, 2, "окно,", "ящик")], "key long, line_no int, word_no int, old string, new string")
    assert fixes.apply_anglicisms(s, latin).collect()[0].text == "ну Какое-то окно, Docker окно"


def test_fixes_of_long_texts(spark):
    words = [f"w{i}" for i in range(3000)]
    s = spark.createDataFrame([(1, " ".join(words), words)], "id long, text string, words array<string>")
    a = spark.createDataFrame([(1, n, k, f"w{k}", f"W{k}") for n, k in enumerate([*range(1, 3000), 0])], "key long, line_no int, word_no int, old string, new string")
    fixed = fixes.apply_case_fixes(s, a).collect()[0]  # the fixes before, word after word from the start of the text, took minutes
    assert fixed.text == " ".join(words).upper() and fixed.words == [w.upper() for w in words]


def test_fixes_that_dont_count(spark):
    told = [(1, "а б в", ["а", "х", "в"]), (2, "а б", ["а", ""]), (3, None, ["а"]), (4, "а", None), (5, "а а б а", ["а", "б", "а"])]
    s = spark.createDataFrame(told, "id long, text string, words array<string>")
    # beyond a word that the text hasn't, no text, no words; a word fixed twice, and one before it after it
    a = spark.createDataFrame([(1, 0, 2, "в", "В"), (1, 1, 0, "а", "А"), (2, 0, -1, "а", "А"), (2, 1, 7, "а", "А"), (3, 0, 0, "а", "А"), (4, 0, 0, "а", "А"), (5, 0, 2, "а", "А"), (5, 1, 2, "А", "а"), (5, 2, 2, "а", "А"), (5, 3, 0, "а", "А")], "key long, line_no int, word_no int, old string, new string")
    got = {r.id: (r.text, r.words) for r in fixes.apply_case_fixes(s, a).collect()}
    assert got == {1: ("А б в", ["А", "х", "в"]), 2: ("а б", ["а", ""]), 3: (None, ["а"]), 4: ("а", None), 5: ("А а б А", ["А", "б", "А"])}


def test_a_cut_after_a_line_end(spark):
    line = lambda n: "x" * n
    rows = [(v, 0, None, line(n)) for v, n in ((1, 12), (2, 13), (3, 14))] + [(v, p, None, line(30)) for v in (1, 2, 3) for p in (1, 2)]
    df = spark.createDataFrame(rows, "video_id long, position long, speaker string, text string").withColumn("start_ms", F.lit(0))
    want = {v: "\n".join(f"[0:00] {t}" for u, _, _, t in rows if u == v) for v in (1, 2, 3)}
    got = {r.video_id: r.body for r in cards.topic_body(df, ["video_id"], 50, 20, 10).collect()}
    assert got == {v: t[:20] + "\n...\n" + t[-10:] for v, t in want.items()} and got[1][19:21] == "\n\n"


def test_documents_and_transcripts(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for v in (1, 2):
        with open(f"{tmp_path}/in/{v}.json", "w") as out:
            json.dump({"video_id": v, "segments": [{"start": 0.5, "end": 1.25, "speaker": None, "text": "раз", "words": [{"text": "раз", "start": 0.5, "end": 1}]}, {"start": 2, "end": 3, "text": "два"}]}, out, indent=1)
    with open(f"{tmp_path}/in/3.json", "w") as out:
        out.write("не документ")
    read = transcripts.read_documents(spark, f"{tmp_path}/in").where("video_id is not null")
    assert [(r.video_id, r.position, r.start_ms, r.end_ms, r.text) for r in read.orderBy("video_id", "position").collect()] == [(v, p, *x) for v in (1, 2) for p, x in enumerate([(500, 1250, "раз"), (2000, 3000, "два")])]
    transcripts.write_transcript(read, f"{tmp_path}/out")
    transcripts.write_transcript(read.where("video_id = 2 and position = 0"), f"{tmp_path}/out")
    assert sorted((r.video_id, r.position) for r in transcripts.transcript_store(spark, f"{tmp_path}/out").read("segments").collect()) == [(1, 0), (1, 1), (2, 0)]


def test_write_index_replaces_only_its_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "а"), (1, 2, "б"), (2, 1, "в")], "video_id long, index_id long, text string")
    transcripts.write_index(rows, f"{tmp_path}/x")
    transcripts.write_index(rows.where("video_id = 1 and index_id = 2").withColumn("text", F.lit("г")), f"{tmp_path}/x")
    assert sorted((r.video_id, r.index_id, r.text) for r in transcripts.index_store(spark, f"{tmp_path}/x").read("entries").collect()) == [(1, 1, "а"), (1, 2, "г"), (2, 1, "в")]


def test_mentions(spark):
    said = spark.createDataFrame([(1, "@Анна Петрова и @анна, @Аннабель a@Анна"), (2, "@Анна"), (1, None)], "video_id long, text string")
    known = spark.createDataFrame([(1, "S0", "Анна"), (1, "S1", "Анна Петрова"), (1, "S2", " ")], "video_id long, label string, name string")
    of = lambda to: [r.text for r in speakers.replace_mentions(said.withColumn("i", F.monotonically_increasing_id()), known, to).orderBy("i").collect()]
    assert of("label") == ["S1 и S0, @Аннабель a@Анна", "@Анна", None]
    assert of("name") == ["Анна Петрова и Анна, @Аннабель a@Анна", "@Анна", None]


def test_bound_topics_and_marks(spark):
    rows = segments(spark, [(0, 10), (10, 20), (30, 45)]).withColumn("t", F.col("position").cast("int"))
    assert [(r.start_ms, r.end_ms) for r in cards.bound_topics(rows, ["video_id"], "t").orderBy("t").collect()] == [(0, 10_000), (10_000, 30_000), (30_000, 45_000)]
    m = spark.createDataFrame([(1, 0, "user", "@0:01-0:02"), (1, 1, "assistant", "тема @0:00-5:00\nбез\nещё [5:00–9:30]"), (1, 2, "assistant", "пусто")], "conv_id long, turn long, role string, text string")
    assert [(r.start, r.end) for r in cards.marked_lines(m).orderBy("place").collect()] == [(0, 300), (300, 570)]


def test_clocks_end_and_late_changes_are_told(spark, tmp_path):
    from lectern.streaming import jobs

    ddl = "video_id long, id long, stage string, created_at timestamp"
    at = lambda s: f"timestamp_seconds({s})"
    parts = [
        [(1, 1, "fetching", 0), (1, 2, "merging", 10), (2, 1, "merging", 5)],
        [(1, 3, "late", 7), (1, 4, "ready", 30), (2, 2, "error", 6)],
        [(1, 5, "merging", 100), (1, 6, "naming", 101)],
    ]
    for k, rows in enumerate(parts):
        made = spark.createDataFrame(rows, "video_id long, id long, stage string, s long").selectExpr("video_id", "id", "stage", f"{at('s')} as created_at")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = [(r.video_id, r.stage, r.us, r.late) for r in jobs.finished(jobs.stage_clocks(stream)).collect()]
    second = 1_000_000
    assert sorted(got, key=repr) == sorted([(1, "fetching", 10 * second, False), (1, "late", None, True), (1, "merging", 20 * second, False), (2, "merging", second, False), (1, "merging", second, False)], key=repr)
    with pytest.raises(ValueError):
        jobs.finished(stream, "update")


def test_tasks_of_stage_durations_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(library, "ROWS_A_TASK", 100)
    videos = spark.range(300).select(F.col("id").alias("video_id"), F.lit("ready").alias("status"))
    times = spark.range(4000).select((F.col("id") % 400).alias("video_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("stage"), (F.col("id") % 5 - 1).alias("seconds"))
    times = times.unionByName(spark.createDataFrame([(None, "s0", 9), (7, None, 9)], "video_id long, stage string, seconds long"))
    got = library.stage_durations(videos, times)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 20  # were as many as the session's, at every size
    sums = {}
    for v, s, x in times.collect():
        sums[v, s] = sums.get((v, s), 0) + x
    kept = {k: x for k, x in sums.items() if x > 0 and k[0] is not None and k[0] < 300}
    want = {(*k, x, sum(y for j, y in kept.items() if j[0] == k[0])) for k, x in kept.items()}
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["video_id", "stage", "seconds", "processed_sec"]
