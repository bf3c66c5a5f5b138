"""Names, broken phrases, splitting, cards and grades: literal cases, and plain loops where SQL can't say it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as f
from lectern.operators import cards, fixes, folds, joining, library, naming, repair, search, speakers
from tests.test_queries import values

SEGMENT = "video_id long, position int, speaker string, text string, start_ms long, end_ms long"


def segments(spark, texts, who="AB"):
    return spark.createDataFrame([(1, i, who[i % len(who)] if who else None, t, 1000 * i, 1000 * i + 900) for i, t in enumerate(texts)], SEGMENT)


def test_ends_of_sentences(spark):
    assert values(spark, f.ends_sentence, ["Да.", "т.д.", "Т.Е.»", "А.", "ы.", "Ура!»)", "и…", "слово", "", "»", "АБ."]) == [True, False, False, False, False, True, True, False, False, False, True]


def test_split_by_words(spark):
    words = "array<struct<text string, start_ms long, end_ms long>>"
    text = "Раз. Два и т.д. ну! А. Блок? Три. Пять. Шесть"
    timed = [(w, 100 * i, 100 * i + 90) for i, w in enumerate(text.split())]
    rows = [(1, 0, text, 0, 5000, timed), (1, 1, text, 0, 5000, None), (1, 2, " Один.  Два. ", 7, 9, None), (1, 3, "", 0, 1, None)]
    got = repair.split_segments(spark.createDataFrame(rows, f"video_id long, position int, text string, start_ms long, end_ms long, words {words}")).orderBy("position", "piece_no").collect()
    first, rest = "Раз. Два и т.д. ну! А. Блок? Три.", "Пять. Шесть"
    n = len(first) + len(rest)
    assert [(r.position, r.text, r.start_ms, r.end_ms, len(r.words)) for r in got] == [
        (0, first, 0, 790, 8), (0, rest, 800, 990, 2), (1, first, 0, 5000 * len(first) // n, 0), (1, rest, 5000 * len(first) // n, 5000, 0), (2, " Один.  Два. ", 7, 9, 0), (3, "", 0, 1, 0),
    ]


def test_owner_of_a_cut_phrase(spark):
    cases = [("Всё ясно. И потом", "Я так решил. Да."), ("Всё ясно. И потом", "Он решил. Я нет."), ("И потом", "Я решил."), ("Ясно. И я потом", "Я решил."), ("Ясно. И вот потом так", "Мне видно."), ("Ясно.", "Я.")]
    df = spark.createDataFrame(cases, "a string, b string").select("*", joining.cut_owner(F.col("a"), F.col("b")).alias("o"))
    got = {(r.a, r.b): r.o for r in df.collect()}
    assert [got[c] for c in cases] == ["right", "left", "left", "left", "left", "left"]


def test_turns_joined_by_verdicts(spark):
    seg = segments(spark, ["Первая мысль и", "её конец. Дальше.", "Ясно. Но вот", "я скажу. Всё", "по порядку."], "ABABB")
    cuts = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True)], "video_id long, position int, is_cut boolean")
    got = joining.stitch_segments(seg, cuts).orderBy("position").collect()
    assert [(r.position, r.speaker, r.text) for r in got] == [(0, "A", "Первая мысль и её конец."), (1, "B", "Дальше."), (2, "A", "Ясно."), (3, "B", "Но вот я скажу. Всё по порядку.")]
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 1900), (1000, 1900), (2000, 2900), (3000, 4900)]


def test_timed_words_go_with_the_phrase(spark):
    w = lambda text, at: [(x, at + 10 * i, at + 10 * i + 9) for i, x in enumerate(text.split())]
    rows = [(1, 0, "A", "Так и", 0, 20, w("Так и", 0)), (1, 1, "B", "есть. Нет-нет, это", 100, 140, w("есть. Нет-нет, это", 100)), (1, 2, "A", "нечто. Да.", 200, 230, w("другое нечто. Да.", 200))]
    seg = spark.createDataFrame(rows, SEGMENT + ", words array<struct<text string, start_ms long, end_ms long>>")
    got = joining.stitch_segments(seg, seg.select("video_id", "position", F.lit(True).alias("is_cut"))).orderBy("position").collect()
    assert [(r.text, [x.text for x in r.words], r.start_ms, r.end_ms) for r in got] == [
        ("Так и есть.", ["Так", "и", "есть."], 0, 109), ("Нет-нет, это нечто.", ["Нет-нет,", "это"], 110, 230), ("Да.", ["другое", "нечто.", "Да."], 200, 229),
    ]


END = re.compile(joining.SENTENCE_END)
ME = re.compile(r"\b(?:я|мне|меня|мой|моя|моё|мои)\b", re.IGNORECASE)


def plain_walk(turns, cuts):
    """(position, text) of the turns (position, speaker, text) of one video, text by text."""
    out = []
    for (position, speaker, text), cut in zip(turns, cuts, strict=True):
        text = text.strip()
        if not out or not cut:
            out.append([position, speaker, text])
            continue
        before = out[-1]
        ends = [m.end() for m in END.finditer(before[2])]
        rest = before[2][ends[-1] :].strip() if ends else ""
        first = END.search(text)
        head = text[: first.end()] if first else text
        if before[1] and before[1] == speaker:
            before[2] = f"{before[2]} {text}".strip()
        elif rest and len(rest.split()) <= 3 and not ME.search(rest) and ME.search(head):
            before[2] = before[2][: ends[-1]].strip()
            out.append([position, speaker, f"{rest} {text}".strip()])
        elif text and head == text:
            before[2] = f"{before[2]} {text}".strip()
        else:
            before[2] = f"{before[2]} {head}".strip()
            out.append([position, speaker, text[len(head) :].strip()])
    return [(p, t) for p, _, t in out]


@pytest.mark.parametrize("block", [10, 1024])
def test_walk_over_turns_like_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK", block)
    rng = random.Random(4)
    said = ["Ясно. И вот", "я знаю. Да", "он ушёл", "Мне пора. Но", "конец.", "…", "", "Так.  Вот и\nон. А", "ну"]
    rows, cut = [], []
    for v in range(8):
        for i in range(30):
            rows.append((v, i, rng.choice(["A", "B", None]), rng.choice(said), 10 * i, 10 * i + 9))
            cut.append((v, i, rng.random() < 0.6))
    is_cut = {(v, i): c for v, i, c in cut}
    want = [(v, p, t) for v in range(8) for own in [[r for r in rows if r[0] == v]] for p, t in plain_walk([r[1:4] for r in own], [is_cut[r[:2]] for r in own])]
    got = joining.stitch_segments(spark.createDataFrame(rows, SEGMENT).repartition(5), spark.createDataFrame(cut, "video_id long, position int, is_cut boolean"))
    assert sorted((r.video_id, r.position, r.text) for r in got.collect()) == sorted(want)


def test_a_remainder_takes_its_word_along(spark):
    rows = [(1, 0, "A", "Ясно. Но", 0, 20, [("Ясно.", 0, 5), ("Но", 10, 20)]), (1, 1, "B", "я скажу.", 30, 60, [("я", 30, 35), ("скажу.", 40, 60)])]
    seg = spark.createDataFrame(rows, SEGMENT + ", words array<struct<text string, start_ms long, end_ms long>>")
    got = joining.stitch_segments(seg, seg.select("video_id", "position", F.lit(True).alias("is_cut"))).orderBy("position").collect()
    assert [(r.text, [x.text for x in r.words], r.start_ms, r.end_ms) for r in got] == [("Ясно.", ["Ясно."], 0, 5), ("Но я скажу.", ["Но", "я", "скажу."], 10, 60)]


def test_names_in_their_cases():
    said = naming.said
    assert said("Мария", "видел Марию") and said("МарияПетрова", "с Марией Петровой") and said("Олег", "Олегом") and not said("Олег", "Олегович")
    assert not said("Мария", "Маркина ушла") and not said("Анна Белова", "Анна пришла") and not said("Я", "я")
    assert naming.cleaned(" Иван  Петров ") == "ИванПетров" and naming.cleaned("ыт") is None and naming.cleaned("Встрча") is None and naming.cleaned("Ann2") is None and naming.cleaned(None) is None


def test_last_own_name_counts(spark):
    seg = segments(spark, ["Меня зовут Олег.", "Тебя зовут Анна?", "С вами был я. Это был Иван Петров!", "меня зовут", "пусто", "Мария"])
    assert {r.speaker: r["name"] for r in naming.spoken_name(seg).collect()} == {"A": "ИванПетров", "B": "Мария"}  # said over two turns


@pytest.mark.parametrize(
    ("texts", "who", "proposed", "want"),
    [
        (["Меня зовут Олег.", "Мы с Анной рады."], "AB", {"A": "Пётр", "B": "Анна"}, {"A": "Анна"}),  # what the other of two says counts last
        (["Мы с Анной рады.", "Да, рады."], "AB", {"A": "Анна"}, {"B": "Анна"}),
        (["Олег, начнём.", "Начнём."], "AB", {"B": "Олег"}, {"B": "Олег"}),
        (["Где Олег был?", "Олег и Олег."], "AB", {"B": "Олег"}, {"B": "Олег"}),
        (["Ничего.", "Я и Олег."], "AB", {"B": "Олег"}, {}),  # only B says it, and not as their own
        (["Меня зовут Олег.", "Меня зовут Олег."], "AB", {}, {}),  # two of one name
        (["Тут Виктор сказал.", "Виктор?"], "AB", {"A": "B", "B": "Виктория"}, {}),  # a label is no name, and nobody said Виктория
    ],
)
def test_names_are_chosen(spark, texts, who, proposed, want):
    props = spark.createDataFrame([(1, k, v) for k, v in proposed.items()], "video_id long, label string, name string")
    got = {r.label: r["name"] for r in naming.choose_names(segments(spark, texts, who), props).collect()}
    assert set(got) == set(who) and {k: v for k, v in got.items() if v not in naming.NICKNAMES} == want
    assert len(set(got.values())) == len(got)


def test_nicknames_are_dealt_evenly(spark):
    rows = spark.createDataFrame([(1, f"S{i:03}", ["лис"]) for i in range(80)] + [(2, "S", [])], "video_id long, label string, used array<string>")
    got = [r for r in naming.deal_nicknames(rows, 5).collect() if r.video_id == 1]
    counts = {n: sum(r.nickname == n for r in got) for n in naming.NICKNAMES}
    assert counts["Лис"] == 0 and set(counts.values()) == {0, 2, 3} and sum(c == 2 for c in counts.values()) == 37
    again = {(r.video_id, r.label): r.nickname for r in naming.deal_nicknames(rows.repartition(3), 5).collect()}
    assert all(again[1, r.label] == r.nickname for r in got)


def test_capitals_and_grades(spark):
    pairs = [("Слово", "слово,", True), ("25", "Тысяч", False), ("25", "Сорок", True), ("и", "Какой-то,", True), ("он", "Для", True), ("мы", "Говорили", True), ("наш", "Москва", False), ("a", "ИТ-шник", False)]
    df = spark.createDataFrame(pairs, "p string, t string, want boolean").select("want", repair.chunk_capital(F.col("p"), F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    rows = [("Наш грейд: Midl, «синьоров»-лид!", None), ("Мидл и Джуниор.", ["Мидл", "и", "Джуниор."]), ("Один Midl тут", None), ("Грейд model, Middle", None), (None, None), ("", [])]
    got = fixes.normalize_terms(spark.createDataFrame(rows, "text string, words array<string>")).collect()
    assert [r.text for r in got] == ["Наш грейд: Middle, «Senior-лид!", "Middle и Junior.", "Один Midl тут", "Грейд model, Middle", None, ""]
    assert got[1].words == ["Middle", "и", "Junior."]


def test_cards_of_odd_answers(spark):
    rows = [(0, "нет карты"), (1, '{"title": "", "content": null}'), (2, '{"Title": "Т", "terms": ["а", 5], "type": {"content": "история о личном"}, "problem": {"x": 1}}'), (3, None), (4, '```json\n{"содержание": "' + "слово " * 200 + '", "content_type": "а, б, в"}\n```')]
    got = {r.key: r for r in cards.topic_cards(spark.createDataFrame(rows, "key int, answer string")).collect()}
    assert set(got) == {2, 4} and got[2].title == "Т" and got[2].terms == "а, 5" and got[2].content_type == "история" and got[2].problem == "" and got[2].message_type == "другое"
    assert len(got[4].content) <= 520 and got[4].content.endswith("слово") and got[4].unfinished and got[4].content_type == "другое" and not got[2].vague
    assert values(spark, lambda c: cards.closed(c, cards.MESSAGE_TYPES), ["Критику.", "«вопрос»", "", "x" * 41 + "совет", "это жалоба соседа"]) == ["критика", "вопрос", "другое", "другое", "жалоба"]
    found = cards.parse_objects(spark.createDataFrame([(1, 'a {"x": {"y": 1}} b {не} {"z": "}"} c'), (2, None), (3, "{")], "key int, answer string")).collect()
    assert [(r.key, r.object_no, r.object) for r in found] == [(1, 0, '{"x":{"y":1}}'), (1, 1, '{"z":"}"}')]


def test_words_at_a_time_and_windows(spark):
    seg = spark.createDataFrame([(1, 0, [("a", 100), ("b", 400)])], "video_id long, position int, words array<struct<text string, start_ms long>>")
    at = spark.createDataFrame([(1, k, t, a) for k, (t, a) in enumerate([(0, 0), (70, 0), (369, 0), (370, 0), (9000, 0), (5, -1)])], "video_id long, p_id int, at_ms long, active int")
    assert [r.word for r in search.asof_word(at, seg).orderBy("p_id").collect()] == [-1, 0, 0, 1, 1, -1]
    rows = [("5:00", None, None), ("5:00", "4:00", None), ("5:00", "6:10", None), ("5:00-5:30", None, ""), (None, None, "@[1:00 – @9:00]"), (None, "3:00", None), ("12", "40", None)]
    got = search.read_window(spark.createDataFrame(rows, "start string, end string, range string")).collect()
    assert [(r.read_start, r.read_end) for r in got] == [(300, 360), (300, 360), (300, 370), (300, 330), (60, 300), (None, None), (12, 40)]


def test_links_versions_and_mentions(spark):
    link = lambda u: values(spark, lambda c: f.deep_link(c, F.lit(65.9)), [u])[0]
    assert link("https://WWW.YouTube.com/watch?t=1&v=a") == "https://WWW.YouTube.com/watch?t=65s&v=a" and link("https://youtu.be/x#q") == "https://youtu.be/x?t=65s#q"
    assert link("https://notyoutube.com/a") == "https://notyoutube.com/a" and link("junk") == "junk" and link("https://youtube.com") == "https://youtube.com/?t=65s"
    rows = spark.createDataFrame([("a", "1.9"), ("a", "1.10"), ("a", "1-2")], "k string, version string")
    assert library.latest_version(rows, ["k"]).first().version == "1.10"
    people = spark.createDataFrame([(1, "S1", "Ян"), (1, "S10", "Яна $1")], "video_id long, label string, name string")
    told = spark.createDataFrame([(1, "S1 и S10, S100"), (2, "S1")], "video_id long, text string")
    assert [r.text for r in speakers.labels_to_mentions(told, people).orderBy("video_id").collect()] == ["@Ян и @Яна $1, S100", "S1"]


def test_vectors_are_pooled(spark):
    r = spark.sql("select array(array(1f, 0f), array(9f, 9f), array(0f, 1f)) t, array(1, 0, 1) m, array(0, 0, 0) z").select(f.mean_pool(F.col("t"), F.col("m")).alias("a"), f.mean_pool(F.col("t"), F.col("z")).alias("b"), f.unit(F.array(F.lit(0.0))).alias("c")).first()
    assert [round(x, 6) for x in r.a] == [0.707107, 0.707107] and r.b is None and r.c is None


def test_vectors_of_unlike_lengths_are_far(spark):
    q = spark.createDataFrame([(1, 1, [1.0, 0.0])], "q_id int, video_id int, q_vec array<double>")
    s = spark.createDataFrame([(1, 7, [2.0, 0.0]), (1, 8, [1.0]), (1, 9, None), (1, 10, [0.0, 0.0])], "video_id int, id int, embedding array<double>")
    assert [(r.id, r.distance) for r in search.search_segments(q, s).orderBy("rank").collect()] == [(7, 0.0), (8, 2.0)]


def test_a_name_far_into_the_next_turns(spark):
    seg = segments(spark, ["И меня", "да", "", "да", " \n зовут", "да", "Мария. " + "и так далее " * 40], "AB")
    assert {r.speaker: r["name"] for r in naming.spoken_name(seg).collect()} == {"A": "Мария"}
    long = segments(spark, ["Итак, " + "слово " * 100 + "меня зовут", "а", "Олег, " + "и ещё " * 60], "AB")
    assert {r.speaker: r["name"] for r in naming.spoken_name(long).collect()} == {"A": "Олег"}


def test_vectors_as_text_near_zero(spark):
    cases = [-1e-8, -0.0, 0.0, 1e-8, -5e-8, -6e-8, 1 / 256, -3 / 256, 0.25]
    got = spark.createDataFrame([(cases,)], "v array<double>").select(f.vec_to_text(F.col("v")).alias("t")).collect()[0].t
    assert got == "[" + ",".join(f"{x:.7f}" for x in cases) + "]"


def test_topics_cut_after_a_line_end(spark):
    lines = [(v, n, "т" * (9 + v if n == 0 else 9)) for v in range(5) for n in range(4)]
    df = spark.createDataFrame(lines, "video_id long, topic_no long, title string").select("*", *(F.lit("").alias(c) for c in ("problem", "conclusion", "message_type")))
    want = {v: "\n".join(f"{n + 1}. {t}." for u, n, t in lines if u == v) for v in range(5)}
    for most in (13, 14, 15, 27, 28, 29):
        assert {r.video_id: r.text for r in cards.topics_brief(df, most).collect()} == {v: t[:most] for v, t in want.items()}


def test_pooling_computes_nothing_twice(spark):
    n = 768  # before, each number of the result asked for the whole sum again: a row took minutes
    rows = [([[float(k % 7 + v), 1.0] * (n // 2) for v in range(20)], [v % 2 for v in range(20)]) for k in range(50)]
    got = spark.createDataFrame(rows, "t array<array<double>>, m array<int>").select(f.mean_pool(F.col("t"), F.col("m")).alias("v")).collect()
    for (t, m), r in zip(rows, got, strict=True):
        mean = [sum(x) / 10 for x in zip(*(v for v, k in zip(t, m, strict=True) if k), strict=True)]
        norm = sum(x * x for x in mean) ** 0.5
        assert r.v == pytest.approx([x / norm for x in mean])
    none = spark.sql("select cast(null as array<array<double>>) t, array(1) m, cast(null as array<double>) v").select(f.mean_pool(F.col("t"), F.col("m")).alias("a"), f.unit(F.col("v")).alias("b")).collect()[0]
    assert none.a is None and none.b is None
