"""Queries over long videos: folds, topics, listings, scopes, corrections and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import cards, embedding, fixes, folds, speakers, voices
from ..sources import bindings as b
from ..sources import transcripts
from ..sources.scratch import shared_folder
from ..streaming import jobs
from .catalog import query

CLOCK = "CASE WHEN {0} >= 3600 THEN ({0}//3600) || ':' || lpad(CAST({0}%3600//60 AS VARCHAR),2,'0') || ':' || lpad(CAST({0}%60 AS VARCHAR),2,'0') ELSE ({0}//60) || ':' || lpad(CAST({0}%60 AS VARCHAR),2,'0') END"
A, Z = CLOCK.format("(start_ms//1000)"), CLOCK.format("(end_ms//1000)")
SPOKEN = f"'[' || {A} || '] ' || CASE WHEN coalesce(speaker,'')='' THEN '' ELSE speaker || ': ' END || text"


def _fold(name: str, source: str, keys: str, order: str, cut: str, since: str = "0") -> str:
    """A recursive CTE `name`: no counts the rows of each key for which `cut` (o: the row, f: the one before, f.origin: where its part began) holds."""
    on = " AND ".join(f"o.{k} = f.{k}" for k in keys.split(", "))
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}),
{name} AS (SELECT *, CAST(0 AS BIGINT) AS no, start_ms AS origin FROM {name}_o WHERE rn = 1 UNION ALL
SELECT * EXCLUDE (cut, p_no, p_origin), p_no + CAST(cut AS BIGINT), CASE WHEN cut THEN start_ms ELSE p_origin END FROM (SELECT o.*, f.no AS p_no, f.origin AS p_origin, {cut} AS cut FROM {name} f JOIN {name}_o o ON {on} AND o.rn = f.rn + 1))"""


def _rejoin(name: str, source: str, keys: str, part: str) -> str:
    return f"""{name}_s AS (SELECT {keys}, no, arg_min(start_ms, position) AS a, arg_max(end_ms, position) AS z, max(no) OVER (PARTITION BY {keys}) AS top FROM {source} GROUP BY {keys}, no),
{name} AS (SELECT {keys}, position, start_ms, end_ms, no - CAST(no > 0 AND no = top AND z - a < 50000 AS BIGINT) AS {part} FROM {source} JOIN {name}_s USING ({keys}, no))"""


CHAPTERS = f"""{b.EPISODES}, {_fold('chf', 'ep', 'video_id', 'position', "(f.end_ms - f.origin >= 600000 OR (f.end_ms - f.origin >= 50000 AND (o.start_ms - f.end_ms >= 2500 OR (o.start_ms - f.end_ms >= 1000 AND coalesce(o.speaker,'') <> coalesce(f.speaker,'')))))")},
{_rejoin('ch', 'chf', 'video_id', 'chapter_no')}"""
ATOMS = f"""{CHAPTERS}, {_fold('atf', 'ch', 'video_id, chapter_no', 'position', '(f.end_ms - f.origin >= 50000 AND o.end_ms - f.origin > 150000)')}, {_rejoin('ato', 'atf', 'video_id, chapter_no', 'atom_no')}"""
WHOLE_ATOMS = "aw AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY chapter_no, atom_no) - 1 AS atom_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM ato GROUP BY video_id, chapter_no, atom_no)"


@query("topic_chapters", f"WITH RECURSIVE {CHAPTERS} SELECT * FROM ch")
def _(s, d):
    return folds.topic_chapters(b.episodes(s, d))


@query("topic_atoms", f"WITH RECURSIVE {ATOMS} SELECT * FROM ato")
def _(s, d):
    return folds.topic_atoms(b.episodes(s, d))


def _atoms(s, d):
    parts = folds.topic_atoms(b.episodes(s, d)).groupBy("video_id", "chapter_no", "atom_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    no = F.row_number().over(Window.partitionBy("video_id").orderBy("chapter_no", "atom_no")) - 1
    return parts.select("video_id", no.cast("long").alias("atom_no"), "start_ms", "end_ms")


@query("topic_groups", f"""WITH RECURSIVE {ATOMS}, {WHOLE_ATOMS}, av AS (SELECT *, atom_no%3=0 OR atom_no%7=1 AS is_start FROM aw), {_fold('tg', 'av', 'video_id', 'atom_no', '(o.is_start OR o.end_ms - f.origin > 360000)')}
SELECT video_id, atom_no, start_ms, end_ms, no AS topic_no FROM tg""")
def _(s, d):  # every third atom starts a topic, of every seventh there is no verdict
    atoms = _atoms(s, d)
    return folds.topic_groups(atoms, atoms.where("atom_no % 7 <> 1").select("video_id", "atom_no", (F.col("atom_no") % 3 == 0).alias("is_start")))


REGIONS = "reg AS (SELECT CAST(label AS BIGINT) AS video_id, vec_id AS region_no, vec_id*400 AS start_ms, vec_id*400 + CASE WHEN vec_id%97=0 THEN 70000 ELSE 300 + vec_id%7*200 END AS end_ms FROM embeddings)"


def _regions(s, d):
    v = F.col("vec_id")
    return b.table(s, d, "embeddings").select(F.col("label").cast("long").alias("video_id"), v.alias("region_no"), (v * 400).alias("start_ms"), (v * 400 + F.when(v % 97 == 0, 70_000).otherwise(300 + v % 7 * 200)).alias("end_ms"))


@query("pack_speech", f"""WITH RECURSIVE {REGIONS}, {_fold('pk', 'reg', 'video_id', 'region_no', '(f.end_ms - f.origin > 200 AND (o.end_ms - f.origin > 22000 OR f.end_ms - f.origin > 15000))')},
p AS (SELECT video_id, no AS piece_no, min(origin) AS a, arg_max(end_ms, region_no) AS z FROM pk GROUP BY 1, 2), q AS (SELECT *, CASE WHEN z-a > 30000 THEN (z-a)//30000+1 ELSE 1 END AS n FROM p WHERE z-a > 200)
SELECT video_id, piece_no, k AS part_no, a + CAST(k*(z-a) AS DOUBLE)/n AS start_ms, a + CAST((k+1)*(z-a) AS DOUBLE)/n AS end_ms FROM (SELECT *, unnest(generate_series(0, n-1)) AS k FROM q)""")
def _(s, d):
    return folds.pack_speech(_regions(s, d))


@query("windows")
def _(s, d):
    return folds.windows(b.episodes(s, d))


@query("fold_repeats")
def _(s, d):  # verdicts for entries of even ids
    e = b.vectors(s, d).select(F.col("video_id").alias("index_id"), "id", "start_ms", "end_ms", "embedding", F.concat(F.lit("Пункт "), F.col("id").cast("string")).alias("text"))
    return folds.fold_repeats(e, e.where("id % 2 = 0").select("index_id", "id", F.concat("text", F.lit(" и другие")).alias("text")), same=0.3, twin=0.35)


def _chunks(s, d):  # a voice of a local speaker is the same in all chunks but the sign of one part
    t = b.turns(s, d).select("video_id", "chunk_no", F.struct("start_ms", "end_ms", "speaker").alias("t"))
    c = t.groupBy("video_id", "chunk_no").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn("end_ms", F.element_at("turns", -1)["end_ms"])
    voice = F.map_from_arrays(F.array(*(F.lit(f"T{k}") for k in range(3))), F.array(*(F.array(*(F.lit(float(j == k)) for j in range(3))) for k in range(3))))
    return c.withColumn("voices", F.when(F.col("chunk_no") % 4 != 3, voice)).withColumn("created_at", F.timestamp_seconds(F.col("chunk_no") * 100 + 86_400))


@query("stitch_turns")
def _(s, d):
    return voices.stitch_turns(_chunks(s, d))


# ---- topics and cards

@query("bound_topics", f"WITH RECURSIVE {CHAPTERS}, o AS (SELECT video_id, chapter_no, arg_min(start_ms, position) AS start_ms, arg_max(end_ms, position) AS z FROM ch GROUP BY 1,2) SELECT video_id, chapter_no, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY chapter_no), z) AS end_ms FROM o")
def _(s, d):
    return cards.bound_topics(folds.topic_chapters(b.episodes(s, d)), ["video_id"], "chapter_no")


@query("topic_body", f"WITH {b.EPISODES}, t AS (SELECT video_id, string_agg({SPOKEN}, chr(10) ORDER BY position) AS body FROM ep GROUP BY 1) SELECT video_id, CASE WHEN length(body) <= 12000 THEN body ELSE left(body, 7000) || chr(10) || '...' || chr(10) || right(body, 4000) END AS body FROM t")
def _(s, d):
    return cards.topic_body(b.episodes(s, d), ["video_id"])


@query("blurb", f"WITH {b.SEGMENTS}, l AS (SELECT *, {SPOKEN} AS line, row_number() OVER (PARTITION BY video_id ORDER BY position) AS p FROM seg), g AS (SELECT video_id, min(start_ms) AS start_ms, arg_max(end_ms, p) AS end_ms, left(string_agg(CASE WHEN p <= 2 THEN line END, ' ' ORDER BY p), 240) AS head, left(arg_max(line, p), 180) AS tail FROM l GROUP BY 1) SELECT video_id, {A} || '–' || {Z} || ' ' || head || ' … ' || tail AS blurb FROM g")
def _(s, d):
    return cards.blurb(b.segments(s, d), ["video_id"])


_PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
_QUOTED = "CAST(to_json(text) AS VARCHAR)"


def _quoted():
    """The whole text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)


@query("keep_items", f"""WITH {b.SEGMENTS}, x AS (SELECT id AS w_id, start_ms/1000.0 AS a, end_ms/1000.0 AS z, {_PLAIN} AS t, start_ms//1000+5 AS m FROM seg), i AS (
SELECT w_id, 0 AS n, least(greatest(CAST(m AS DOUBLE), a), z) AS s, z AS e, a, z, left('Тема. ' || t, 400) AS text FROM x WHERE t <> '' UNION ALL SELECT w_id, 0, least(greatest(CAST(m AS DOUBLE), a), z), z, a, z, 'Тема' FROM x WHERE t = '' UNION ALL SELECT w_id, 1, a, z, a, z, left(t, 400) FROM x WHERE t <> '')
SELECT w_id, CAST(row_number() OVER (PARTITION BY w_id ORDER BY s, e, n) AS INTEGER) AS place, CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end", text FROM i""")
def _(s, d):  # an answer with two items, and with an empty one
    mark = f.clock(F.floor(F.col("start_ms") / 1000) + 5)
    answer = F.concat(F.lit('Вот: [{"title": "Тема", "text": '), _quoted(), F.lit(', "start": "['), mark, F.lit(']", "end": "9999:00"}, {"text": '), _quoted(), F.lit('}, {"title": " "}] конец'))
    return cards.keep_items(b.segments(s, d).select(F.col("id").alias("w_id"), answer.alias("answer"), (F.col("start_ms") / 1000).alias("win_start"), (F.col("end_ms") / 1000).alias("win_end")))


@query("concrete", f"WITH {b.EPISODES}, k AS (SELECT video_id AS key, start_ms, end_ms, 'слово ' || position//5%2 AS text FROM ep WHERE position%6 <> 0), n AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY key ORDER BY start_ms) THEN 0 ELSE 1 END AS nw FROM k), g AS (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT key, text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY key, g, text")
def _(s, d):
    text = F.when(F.col("position") % 6 == 0, "общие слова").otherwise(F.concat(F.lit("слово "), (F.floor(F.col("position") / 5) % 2).cast("string")))
    return cards.concrete(b.episodes(s, d).select(F.col("video_id").alias("key"), "start_ms", "end_ms", text.alias("text")), "общие слова")


@query("topics_overview", f"WITH {b.SEGMENTS} SELECT video_id, 'Темы этого видео:' || chr(10) || string_agg((position+1) || '. Тема ' || position || ' (' || {A} || '–' || {Z} || ')', chr(10) ORDER BY position) AS text FROM seg GROUP BY 1")
def _(s, d):
    return cards.topics_overview(b.segments(s, d).select("video_id", F.col("position").alias("topic_no"), F.concat(F.lit("Тема "), F.col("position").cast("string")).alias("title"), "start_ms", "end_ms"))


@query("index_listing", f"""WITH {b.EPISODES}, l AS (SELECT video_id AS index_id, id, start_ms, end_ms, text || ' ' || repeat('слово ', CAST(position%90 AS INTEGER)) AS text FROM ep), t AS (SELECT *, {_PLAIN} AS t, count(*) OVER (PARTITION BY index_id) AS n FROM l), c AS (SELECT *, '[' || {A} || '–' || {Z} || '] ' || CASE WHEN length(t) <= 420 THEN t ELSE rtrim(left(t, 419), ' ') || '…' END AS line FROM t),
u AS (SELECT *, sum(length(line)) OVER (PARTITION BY index_id ORDER BY start_ms, id) AS used FROM c)
SELECT index_id, coalesce(string_agg(CASE WHEN used <= 9000 THEN line END, chr(10) ORDER BY start_ms, id), '') || CASE WHEN count(*) FILTER (used <= 9000) < max(n) THEN chr(10) || '…и ещё ' || (max(n) - count(*) FILTER (used <= 9000)) || ' пунктов, ищи их через поиск по индексу' ELSE '' END AS listing FROM u GROUP BY 1""")
def _(s, d):
    text = F.concat("text", F.lit(" "), F.repeat(F.lit("слово "), (F.col("position") % 90).cast("int")))
    return cards.index_listing(b.episodes(s, d).select(F.col("video_id").alias("index_id"), "id", "start_ms", "end_ms", text.alias("text")))


@query("span_read", f"""WITH {b.EPISODES}, w AS (SELECT id AS w_id, video_id AS v, start_ms AS a, start_ms+90000 AS z FROM ep), c AS (SELECT video_id, id, start_ms, start_ms + CASE WHEN position%10=0 THEN 600000 ELSE 60000 END AS end_ms FROM ep)
SELECT w_id, 'card' AS kind, CAST(row_number() OVER (PARTITION BY w_id ORDER BY start_ms, id) AS INTEGER) AS place, id FROM w JOIN c ON v=video_id AND start_ms < z AND end_ms > a WHERE NOT (start_ms <= a AND end_ms >= z AND end_ms-start_ms > 2*(z-a))
UNION ALL SELECT * FROM (SELECT w_id, 'segment', CAST(row_number() OVER (PARTITION BY w_id ORDER BY position) AS INTEGER) AS place, id FROM w JOIN ep ON v=video_id AND start_ms <= z AND end_ms >= a) WHERE place <= 40""")
def _(s, d):
    e = b.episodes(s, d)
    w = e.select(F.col("id").alias("w_id"), "video_id", "start_ms", (F.col("start_ms") + 90_000).alias("end_ms"))
    c = e.withColumn("end_ms", F.col("start_ms") + F.when(F.col("position") % 10 == 0, 600_000).otherwise(60_000))
    return cards.span_read(w, c, e)


@query("marked_lines", f"""WITH {b.SEGMENTS}, m AS (SELECT video_id AS conv_id, position AS turn, speaker, {_PLAIN} AS t, start_ms, end_ms, row_number() OVER (PARTITION BY video_id ORDER BY position DESC) AS back FROM seg),
k AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS newest FROM m WHERE back <= 6 AND coalesce(speaker, '') <> 'SPEAKER_00' AND end_ms//1000 > start_ms//1000)
SELECT conv_id, CAST(p AS INTEGER) AS place, CASE p WHEN 1 THEN 'Первая @' || {A} || '-' || {Z} ELSE CASE WHEN length(trim('[' || {A} || '–' || {Z} || '] ' || t, ' ')) > 160 THEN rtrim(left('[' || {A} || '–' || {Z} || '] ' || t, 159), ' ') || '…' ELSE trim('[' || {A} || '–' || {Z} || '] ' || t, ' ') END END AS line, CAST(start_ms//1000 AS DOUBLE) AS start, CAST(end_ms//1000 AS DOUBLE) AS "end" FROM k, (VALUES (1), (2)) v(p) WHERE turn = newest""")
def _(s, d):
    a, z = f.clock(F.col("start_ms") / 1000), f.clock(F.col("end_ms") / 1000)
    text = F.concat(F.lit("Первая @"), a, F.lit("-"), z, F.lit("\nбез метки\n["), a, F.lit("–"), z, F.lit("] "), f.squeezed(F.col("text")))
    role = F.when(F.col("speaker") == "SPEAKER_00", "user").otherwise("assistant")
    return cards.marked_lines(b.segments(s, d).select(F.col("video_id").alias("conv_id"), F.col("position").alias("turn"), role.alias("role"), text.alias("text")))


@query("expand_quotes", f"""WITH {b.SEGMENTS}, {b.SPEAKERS}, x AS (SELECT seg.*, CASE WHEN speaker IS NULL AND name IS NULL THEN '' ELSE coalesce(name, speaker) || ': ' END || trim(text, ' ') AS mess, {A} || '-' || {Z} AS mark FROM seg LEFT JOIN spk ON spk.video_id=seg.video_id AND label=speaker)
SELECT video_id AS conv_id, position AS turn, 'Смотри [' || mark || ']{{{{' || chr(10) || mess || chr(10) || '}}}} и @[нет такого 900:00-901:00].' AS text FROM x""")
def _(s, d):
    told = speakers.with_speaker_name(b.segments(s, d), b.speakers(s, d))
    token = F.concat(F.lit("@["), f.squeezed(F.substring("text", 1, 20)), F.lit("... "), f.clock(F.col("start_ms") / 1000), F.lit("-"), f.clock(F.col("end_ms") / 1000), F.lit("]"))
    m = told.select(F.col("video_id").alias("conv_id"), F.col("position").alias("turn"), "video_id", F.concat(F.lit("Смотри "), token, F.lit(" и @[нет такого 900:00-901:00].")).alias("text"))
    return cards.expand_quotes(m, told)


def _places(s, d):
    e, v = b.episodes(s, d), F.col("video_id")
    videos = e.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))
    role = F.element_at(F.array(F.lit("only"), F.lit("skip"), F.lit("subject")), (F.col("position") % 3 + 1).cast("int"))
    end = F.when(F.col("position") % 20 != 0, F.col("end_ms") + 40_000)
    return e.select(v.alias("q_id"), "video_id", role.alias("role"), "start_ms", end.alias("end_ms")), videos


@query("resolve_places")
def _(s, d):
    return cards.resolve_places(*_places(s, d))


@query("index_spans")
def _(s, d):
    places, videos = _places(s, d)
    area = cards.resolve_places(places, videos).where("kind = 'range' and q_id % 4 <> 1").drop("kind")
    hits = b.episodes(s, d).select(F.col("video_id").alias("q_id"), "start_ms", "end_ms")
    return cards.index_spans(videos.select(F.col("video_id").alias("q_id"), F.when(F.col("video_id") % 3 == 0, "all").otherwise("found").alias("scope")), hits, area)


@query("current_sentence")
def _(s, d):
    return cards.current_sentence(b.segments(s, d).withColumn("at_ms", F.col("start_ms") + 1700 * F.col("position"))).select("id", "sentence")


@query("export_dialogue", f"""WITH {b.SEGMENTS}, x AS (SELECT *, {_QUOTED} AS t FROM seg) SELECT video_id, 'Видео-' || video_id || '-a.json' AS file_name, '{{"title":"Видео №' || video_id || ' (a)","messages":[' || string_agg('{{' || CASE WHEN video_id%3=0 OR speaker IS NULL THEN '' ELSE '"speaker":"' || speaker || '",' END || '"start":' || start_ms || ',"end":' || end_ms || ',"text":' || t || '}}', ',' ORDER BY position) || ']}}' AS dialogue FROM x GROUP BY video_id""")
def _(s, d):
    seg = b.segments(s, d).withColumnRenamed("speaker", "speaker_name")
    v = seg.select("video_id").distinct().select("video_id", F.concat(F.lit("Видео №"), F.col("video_id").cast("string"), F.lit(" (a)")).alias("title"), (F.col("video_id") % 3 != 0).alias("opt_diarize"))
    return transcripts.export_dialogue(v, seg)


@query("read_documents", f"WITH {b.SEGMENTS} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY position) - 1 AS position, start_ms, end_ms, speaker, text FROM seg")
def _(s, d):  # each conversation as one nested JSON document, read back
    seg = F.struct("position", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker", "text")
    docs = b.segments(s, d).groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(seg)).alias("segments"))).alias("j"))
    read = docs.select("video_id", F.from_json("j", transcripts.DOCUMENT).alias("doc")).select("video_id", "doc.segments")
    return transcripts.document_segments(read).drop("words")


# ---- corrections

# every word of Latin letters is to get a capital; fixes of other words and places don't count
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


def _fixes(s, d):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    line = F.transform(w, lambda x, i: F.when(x.rlike("^[a-z]+$"), F.concat(i.cast("string"), F.lit(" "), x, F.lit(" -> "), F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))))
    answer = F.concat(F.lit("Правки:\n"), F.array_join(F.filter(line, lambda x: x.isNotNull()), "\n"), F.lit("\n0 other Other\nНЕТ"))
    return fixes.parse_fixes(b.segments(s, d).select(F.col("id").alias("key"), answer.alias("answer")))


@query("parse_fixes", f"""WITH {b.SEGMENTS}, w AS (SELECT id, {_WORDS} AS w FROM seg), x AS (SELECT id, unnest(w) AS x, unnest(generate_series(0, len(w)-1)) AS i FROM w), k AS (SELECT id AS key, row_number() OVER (PARTITION BY id ORDER BY i) AS line_no, i AS word_no, x AS old, upper(x[1]) || x[2:] AS new FROM x WHERE regexp_matches(x, '^[a-z]+$'))
SELECT key, CAST(line_no AS INTEGER) AS line_no, CAST(word_no AS INTEGER) AS word_no, old, new FROM k UNION ALL SELECT seg.id, CAST(greatest(count(k.key), 1) + 1 AS INTEGER), 0, 'other', 'Other' FROM seg LEFT JOIN k ON k.key = seg.id GROUP BY seg.id""")
def _(s, d):
    return _fixes(s, d)


@query("apply_case_fixes", f"WITH {b.SEGMENTS} SELECT id, array_to_string(list_transform({_WORDS}, lambda x: CASE WHEN regexp_matches(x, '^[a-z]+$') THEN upper(x[1]) || x[2:] ELSE x END), ' ') AS text FROM seg")
def _(s, d):
    done = fixes.apply_case_fixes(b.segments(s, d).withColumn("words", F.filter(F.split("text", r"\s+"), lambda x: x != "")), _fixes(s, d))
    return done.select("id", F.array_join(F.filter(F.split("text", r"\s+"), lambda x: x != ""), " ").alias("text"))


@query("embed_text")
def _(s, d):
    return embedding.embed(b.segments(s, d).select("id", "text"), "text", embedding.hashing_model(64), 64)


# ---- scalars

@query("parse_clock", f"WITH {b.EPISODES} SELECT id, CAST(start_ms//1000 AS DOUBLE) AS seconds FROM ep")
def _(s, d):
    return b.episodes(s, d).select("id", f.parse_clock(F.concat(F.lit(" @["), f.clock(F.col("start_ms") / 1000), F.lit("]"))).alias("seconds"))


@query("parse_range", f"WITH {b.EPISODES} SELECT id, CASE WHEN end_ms//1000 > start_ms//1000 THEN CAST(start_ms//1000 AS DOUBLE) END AS a, CASE WHEN end_ms//1000 > start_ms//1000 THEN CAST(end_ms//1000 AS DOUBLE) END AS z FROM ep")
def _(s, d):
    r = f.parse_range(F.concat(F.lit("@"), f.clock(F.col("start_ms") / 1000), F.lit(" – @"), f.clock(F.col("end_ms") / 1000)))
    return b.episodes(s, d).select("id", r["start"].alias("a"), r["end"].alias("z"))


@query("seek_marks", f"WITH {b.EPISODES} SELECT id, 'на @' || {A} || '-' || {Z} || ' тут' AS text FROM ep")
def _(s, d):
    return b.episodes(s, d).select("id", f.seek_marks(F.concat(F.lit("на "), cards.stamp(F.col("start_ms"), F.col("end_ms")), F.lit(" тут"))).alias("text"))


@query("vector_codec", "SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.7f', CAST(x AS DOUBLE))), ',') || ']' AS text, CAST(len(embedding) AS BIGINT) AS n, true AS back FROM embeddings")
def _(s, d):
    text = f.vec_to_text(F.col("embedding"))
    near = F.forall(F.zip_with("embedding", f.text_to_vec(text), lambda x, y: F.abs(x - y) <= 1e-7), lambda x: x)
    return b.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), text.alias("text"), F.size(f.text_to_vec(text)).cast("long").alias("n"), near.alias("back"))


@query("version_key", "SELECT p_partkey AS id, [2025, CAST(p_size AS INTEGER), CAST(p_partkey%10 AS INTEGER)] :: VARCHAR AS key FROM part")
def _(s, d):
    k = f.version_key(F.concat_ws(".", F.lit("v2025"), F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string")))
    return b.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("["), F.array_join(k.cast("array<string>"), ", "), F.lit("]")).alias("key"))


@query("plain_text", f"WITH {b.SEGMENTS} SELECT id, trim(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g') || ' ссылка код жирно' || chr(10) || 'на двух строках' || chr(10) || 'пункт и курсив' || chr(10) || 'плюс 2 * 3' || chr(10) || chr(10) || 'конец') AS text FROM seg")
def _(s, d):
    return b.segments(s, d).select("id", f.plain_text(F.concat(F.lit("  ## "), "text", F.lit(" [ссылка](http://a.b/c) `код` **жирно\nна двух строках**\r\n\n\n\n- пункт и *курсив*\n + плюс 2 * 3  \n\n\n\nконец\n"))).alias("text"))


# ---- streams, run to the end of what there is

@query("stream_stage_timers", "WITH c AS (SELECT user_id AS video_id, event_type AS stage, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT video_id, stage, CAST(sum(us) AS BIGINT) AS us FROM c WHERE us IS NOT NULL AND stage <> 'error' GROUP BY 1, 2")
def _(s, d):
    changes = jobs.table_stream(s, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at"))
    return jobs.finished(jobs.stage_clocks(changes)).where("not late").groupBy("video_id", "stage").agg(F.sum("us").alias("us"))


@query("stage_timers", "WITH c AS (SELECT user_id AS video_id, event_type AS stage, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT video_id, stage, CAST(sum(us) AS BIGINT) AS us FROM c WHERE us IS NOT NULL AND stage <> 'error' GROUP BY 1, 2")
def _(s, d):
    return jobs.stage_times(b.table(s, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at")))


@query("stream_append_asr", "SELECT conv_id AS video_id, turn AS chunk_no, turn*60000+500 AS start_ms, turn*60000+500+length(text) AS end_ms, text FROM conversations")
def _(s, d):  # every chunk comes twice
    segment = F.struct(F.lit(500).cast("long").alias("start_ms"), (F.length("text") + 500).cast("long").alias("end_ms"), "text")
    c = jobs.table_stream(s, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("chunk_no"), F.timestamp_seconds(F.col("turn") * 60 + 86_400).alias("created_at"), (F.col("turn") * 60_000).alias("offset_ms"), F.array(segment).alias("segments"))
    return jobs.finished(jobs.append_asr(c.withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_again")))


def _event_stream(s, d):
    return jobs.table_stream(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("created_at"))


@query("stream_event_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1,2")
def _(s, d):
    return jobs.finished(jobs.event_counts(_event_stream(s, d)), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_heartbeat_gaps", "WITH m AS (SELECT user_id AS video_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 900 SECOND THEN 0 ELSE 1 END AS nw FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT video_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY video_id, s")
def _(s, d):
    return jobs.finished(jobs.heartbeat_sessions(_event_stream(s, d)), "complete").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


_MARK = "date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE"


@query("stream_event_counts_sliding", f"""WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS window_start, event_type AS kind FROM events, (VALUES (0), (1), (2), (3)) v(k))
SELECT window_start, kind, count(*) AS n FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT {_MARK} FROM events) GROUP BY 1, 2""")
def _(s, d):  # each hour, every quarter of one, once it is closed
    return jobs.finished(jobs.event_counts(_event_stream(s, d), every="15 minutes")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_heartbeat_gaps_closed", f"""WITH m AS (SELECT user_id AS video_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 900 SECOND THEN 0 ELSE 1 END AS nw FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT video_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY video_id, s HAVING max(ts) + INTERVAL 900 SECOND <= (SELECT {_MARK} FROM events)""")
def _(s, d):
    return jobs.finished(jobs.heartbeat_sessions(_event_stream(s, d))).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("stream_stitch_turns")
def _(s, d):  # chunks as a stream of the files that hold them
    place = f"{shared_folder(s)}/chunks-{uuid.uuid4().hex}"
    chunks = _chunks(s, d)
    chunks.write.parquet(place)
    return jobs.finished(jobs.stitch_turns(s.readStream.schema(chunks.schema).parquet(place)))


@query("stream_refill")
def _(s, d):  # rows without a vector get one as they come, if their video is ready; of every third video they wait
    place = f"{shared_folder(s)}/refill-{uuid.uuid4().hex}"
    e = b.vectors(s, d).select("video_id", "id", "text", "embedding")
    e.write.parquet(f"{place}/in")
    videos = e.select("video_id", F.when(F.col("video_id") % 3 == 0, "queued").otherwise("ready").alias("status")).distinct()
    jobs.refill(s.readStream.schema(e.schema).parquet(f"{place}/in"), lambda: videos, "text", embedding.hashing_model(64), 64, f"{place}/out", f"{place}/state").awaitTermination()
    return jobs.refilled(s, f"{place}/out", e.schema).select("id", "text", "embedding")


# ---- sinks, written to the shared folder and read back

@query("write_transcript", f"WITH {b.SEGMENTS} SELECT id, CASE WHEN video_id%3=0 THEN 'новый ' || text ELSE text END AS text FROM seg WHERE NOT (video_id%3=0 AND position%2=1) AND NOT video_id%7=5")
def _(s, d):  # every third video is written again, with half of its segments; of every seventh the new transcript is empty
    return _written(s, d).read("segments").select("id", "text")


@query("write_transcript_labels", f"WITH {b.SEGMENTS}, f AS (SELECT video_id, speaker AS label, min(position) AS p FROM seg WHERE speaker IS NOT NULL AND NOT (video_id%3=0 AND position%2=1) AND NOT video_id%7=5 GROUP BY 1,2) SELECT video_id, label, CAST(row_number() OVER (PARTITION BY video_id ORDER BY p) AS INTEGER) AS label_no, label AS name FROM f")
def _(s, d):
    return _written(s, d).read("speakers")


def _written(s, d):
    path = f"{shared_folder(s)}/transcripts-{uuid.uuid4().hex}"
    seg = b.segments(s, d)
    transcripts.write_transcript(seg, path, buckets=8)
    new = seg.where("video_id % 3 = 0 and position % 2 = 0 and video_id % 7 <> 5").withColumn("text", F.concat(F.lit("новый "), "text"))
    transcripts.write_transcript(new, path, seg.where("video_id % 3 = 0 or video_id % 7 = 5").select("video_id"))
    return transcripts.transcript_store(s, path)


@query("write_index", "SELECT vec_id AS id, CASE WHEN label%2=0 THEN 'новый' ELSE 'старый' END AS text, CASE WHEN label%2=0 THEN 'ready' ELSE 'building' END AS status FROM embeddings WHERE NOT (label%4=2 AND vec_id%2=1)")
def _(s, d):  # the indexes of every second video are built anew, one of them without entries, and these are marked
    path = f"{shared_folder(s)}/indexes-{uuid.uuid4().hex}"
    e = b.vectors(s, d).select("video_id", (F.col("video_id") * 2 + F.col("id") % 2).alias("index_id"), "id", F.lit("старый").alias("text"))
    new = e.where("video_id % 2 = 0 and not (video_id % 4 = 2 and id % 2 = 1)").withColumn("text", F.lit("новый"))
    indexes = e.select("video_id", "index_id").distinct().withColumn("status", F.lit("building"))
    transcripts.write_index(e, path, buckets=8)
    transcripts.write_index(new, path, indexes.where("video_id % 2 = 0"))
    built = transcripts.mark_ready(indexes.where("video_id % 2 = 0"), new).unionByName(indexes.where("video_id % 2 = 1"))
    return transcripts.index_store(s, path).read("entries").join(built, ["video_id", "index_id"]).select("id", "text", "status")
