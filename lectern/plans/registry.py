"""All queries over the driver's tables, each with the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import ann, library, repair, search, spans, speakers
from ..sources import bindings as b
from ..operators.nearest import nearest
from ..sources.scratch import stored
from . import speech, timeline  # noqa: F401
from .catalog import oracle_sql, queries, query  # noqa: F401

FLAGSHIP = "search_citations"
#: The time at which reports on what runs are made.
NOW = "1996-06-01 00:00:00"

CLOCK = "CASE WHEN {0} >= 3600 THEN ({0}//3600) || ':' || lpad(CAST({0}%3600//60 AS VARCHAR),2,'0') || ':' || lpad(CAST({0}%60 AS VARCHAR),2,'0') ELSE ({0}//60) || ':' || lpad(CAST({0}%60 AS VARCHAR),2,'0') END"
WORDS = r"list_filter(string_split_regex(trim({0}, ' '), '\s+'), lambda x: x <> '')"
CLOSED = r"regexp_matches(rtrim({0}, ' '), '[.!?…][\"''»”)\]]*$')"
UNION = """isl AS (SELECT video_id, start_ms, end_ms, sum(nw) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {0})),
uni AS (SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM isl GROUP BY video_id, g)"""


def _hits(s, d):  # every segment is a hit; those of every third turn reach three times as far
    return b.segments(s, d).select("video_id", "start_ms", (F.col("start_ms") + F.when(F.col("position") % 3 == 0, 3).otherwise(1) * (F.col("end_ms") - F.col("start_ms"))).alias("end_ms"))


def _holes(s, d):
    return b.segments(s, d).where("position = 1 or position = 6").select("video_id", "start_ms", "end_ms")


HITS = "hit AS (SELECT video_id, start_ms, start_ms + CASE WHEN position%3=0 THEN 3 ELSE 1 END*(end_ms-start_ms) AS end_ms FROM seg)"


# ---- search

_TOP = f"""top AS (SELECT q_id, id, start_ms, end_ms, speaker, text, video_id, distance, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS rank FROM (
SELECT q.q_id, v.id, v.start_ms, v.end_ms, v.speaker, v.text, v.video_id, round(1 - list_dot_product(q_vec, embedding) / sqrt(list_dot_product(q_vec, q_vec) * list_dot_product(embedding, embedding)), 6) AS distance FROM q JOIN vec v ON v.video_id = q.video_id WHERE embedding IS NOT NULL) QUALIFY rank <= 8)"""


def _top(s, d):
    return search.search_segments(b.questions(s, d), b.vectors(s, d))


@query("search_segments", f"WITH {b.VECTORS}, {_TOP} SELECT q_id, CAST(rank AS INTEGER) AS rank, id, distance FROM top")
def _(s, d):
    return _top(s, d).select("q_id", "rank", "id", "distance")


@query("search_citations", f"""WITH {b.VECTORS}, {b.SPEAKERS}, {_TOP} SELECT q_id, '[' || string_agg('{{"type":"segment","segmentId":' || id || ',"start":' || start_ms || ',"end":' || end_ms || ',"speakerName":"' || coalesce(name, speaker, 'Без спикера') || '","text":' || CAST(to_json(text) AS VARCHAR) || '}}', ',' ORDER BY rank) || ']' AS citations
FROM top LEFT JOIN spk ON spk.video_id = top.video_id AND spk.label = top.speaker GROUP BY q_id""")
def _(s, d):
    return search.citations(speakers.with_speaker_name(_top(s, d), b.speakers(s, d)))


_IDX = "idx AS (SELECT DISTINCT label*2+vec_id%2 AS index_id, CASE WHEN label=9 THEN 'building' ELSE 'ready' END AS status FROM embeddings)"


def _entries(s, d):
    return b.vectors(s, d).withColumn("index_id", F.col("video_id") * 2 + F.col("id") % 2)


def _indexes(s, d):
    e = _entries(s, d).select("video_id", "index_id").distinct()
    kind = F.when(F.col("index_id") % 3 == 0, "moments").when(F.col("index_id") % 3 == 1, "custom").otherwise("agent")
    return e.withColumn("status", F.when(F.col("video_id") == 9, "building").otherwise("ready")).withColumn("kind", kind).withColumn("created_at", F.col("index_id") * 7 % 5)


@query("search_entries", f"""WITH {b.VECTORS}, {_IDX} SELECT q_id, index_id, CAST(rank AS INTEGER) AS rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id, index_id ORDER BY distance, id) AS rank FROM (
SELECT q.q_id, v.video_id*2+v.id%2 AS index_id, v.id, round(1 - list_dot_product(q_vec, embedding) / sqrt(list_dot_product(q_vec, q_vec) * list_dot_product(embedding, embedding)), 6) AS distance FROM q JOIN vec v ON v.video_id=q.video_id WHERE embedding IS NOT NULL) WHERE index_id IN (SELECT index_id FROM idx WHERE status='ready')) WHERE rank <= 8""")
def _(s, d):
    return search.search_entries(b.questions(s, d), _entries(s, d), _indexes(s, d)).select("q_id", "index_id", "rank", "id", "distance")


@query("merge_hits", f"""WITH {b.VECTORS}, d AS (SELECT q.q_id, v.id%3 AS group_no, v.id, round(1 - list_dot_product(q_vec, embedding) / sqrt(list_dot_product(q_vec, q_vec) * list_dot_product(embedding, embedding)), 6) AS distance FROM q JOIN vec v ON v.video_id=q.video_id WHERE embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id, group_no ORDER BY distance, id) AS r FROM d QUALIFY r <= 8), n AS (SELECT *, (SELECT count(DISTINCT group_no) FROM r x WHERE x.q_id=r.q_id) AS n FROM r),
p AS (SELECT *, CASE WHEN n=1 THEN r<=8 ELSE r <= greatest(1, 8//n) END AS picked FROM n),
l AS (SELECT *, sum(picked::INT) OVER (PARTITION BY q_id) AS many, row_number() OVER (PARTITION BY q_id, picked ORDER BY distance, group_no, r) AS fill FROM p)
SELECT q_id, CAST(place AS INTEGER) AS place, group_no, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, picked DESC, group_no, r) AS place FROM l WHERE picked OR fill <= 8-many) WHERE place <= 8""")
def _(s, d):
    near = nearest(b.questions(s, d), b.vectors(s, d).withColumn("group_no", F.col("id") % 3), ["q_id", "group_no"], 8)
    return search.merge_hits(near.select("q_id", "group_no", "id", "distance"))


def _corpus(s, d):
    e = b.table(s, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), "embedding")
    return rows, rows.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_vec"))


@query("search_corpus_exact", """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id AS q_id, x.id, round(1 - list_dot_product(a.v, x.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(x.v, x.v)), 6) AS distance FROM e a, e x WHERE a.id%20=0)
SELECT q_id, id, distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS r FROM d) WHERE r <= 8""")
def _(s, d):  # of every twentieth vector the nearest of all videos
    rows, questions = _corpus(s, d)
    return ann.search_exact(questions, rows)


@query("search_corpus")
def _(s, d):  # the same over an index of lists; all rows are in it, the distances are exact, and some neighbours may be missed
    rows, questions = _corpus(s, d)
    fitted = ann.fit(rows)
    return ann.search(stored(ann.index_rows(rows, fitted), "ann-index"), questions, rows, fitted)


@query("find_segments", f"""WITH {b.SEGMENTS}, t AS (SELECT item_id AS q_id, item_id AS video_id, list_transform(list_distinct(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]{{4,}}'), lambda x: lower(x))), lambda x: x) AS all_terms, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{4,}}') AS ws FROM benchmark),
k AS (SELECT q_id, video_id, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:4] AS terms FROM t)
SELECT q_id, CAST(place AS INTEGER) AS place, id FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY position) AS place FROM k JOIN seg USING (video_id) WHERE len(list_filter(terms, lambda x: contains(lower(text), x))) > 0) WHERE place <= 12""")
def _(s, d):
    q = b.table(s, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("item_id").alias("video_id"), F.col("text").alias("question"))
    return search.find_segments(q, b.segments(s, d)).select("q_id", "place", "id")


def _windows(s, d):
    return b.segments(s, d).select(F.col("id").alias("w_id"), "video_id", "start_ms", (F.col("start_ms") + 30_000).alias("end_ms"))


@query("segments_between", f"WITH {b.SEGMENTS}, w AS (SELECT id AS w_id, video_id, start_ms AS a, start_ms+30000 AS z FROM seg) SELECT w_id, CAST(place AS INTEGER) AS place, position FROM (SELECT w_id, seg.position, row_number() OVER (PARTITION BY w_id ORDER BY seg.position) AS place FROM w JOIN seg USING (video_id) WHERE start_ms <= z AND end_ms >= a) WHERE place <= 40")
def _(s, d):
    return search.segments_between(_windows(s, d), b.segments(s, d)).select("w_id", "place", "position")


@query("result_lines", f"""WITH {b.SEGMENTS}, w AS (SELECT id AS w_id, video_id, start_ms AS a, start_ms+30000 AS z FROM seg), p AS (SELECT w_id AS q_id, seg.*, row_number() OVER (PARTITION BY w_id ORDER BY seg.position) AS place FROM w JOIN seg USING (video_id) WHERE start_ms <= z AND end_ms >= a)
SELECT q_id, string_agg('[' || {CLOCK.format('(start_ms//1000)')} || '–' || {CLOCK.format('(end_ms//1000)')} || '] ' || CASE WHEN speaker IS NULL THEN '' ELSE speaker || ': ' END || text, chr(10) ORDER BY place) AS lines FROM p WHERE place <= 8 GROUP BY q_id""")
def _(s, d):
    seg = b.segments(s, d)
    placed = search.segments_between(_windows(s, d), seg).select(F.col("w_id").alias("q_id"), "place", "video_id", "position")
    return search.result_lines(placed.join(seg, ["video_id", "position"]).withColumn("speaker_name", F.lit("")))


@query("list_entries", f"WITH {b.VECTORS}, {_IDX} SELECT index_id, CAST(place AS INTEGER) AS place, id FROM (SELECT video_id*2+id%2 AS index_id, id, row_number() OVER (PARTITION BY video_id*2+id%2 ORDER BY start_ms, id) AS place FROM vec) WHERE place <= 60 AND index_id IN (SELECT index_id FROM idx WHERE status='ready')")
def _(s, d):
    return search.list_entries(_entries(s, d), _indexes(s, d)).select("index_id", "place", "id")


@query("asof_segment", f"WITH {b.SEGMENTS}, p AS (SELECT video_id, id AS p_id, start_ms + 7000*(position%5) - 200 AS t FROM seg) SELECT video_id, p_id, coalesce((SELECT max(position) FROM seg s WHERE s.video_id=p.video_id AND s.start_ms <= p.t+150), -1) AS active FROM p")
def _(s, d):
    seg = b.segments(s, d)
    return search.asof_segment(seg.select("video_id", F.col("id").alias("p_id"), (F.col("start_ms") + 7000 * (F.col("position") % 5) - 200).alias("at_ms")), seg)


# ---- spans

@query("union_spans", f"WITH {b.SEGMENTS}, {HITS}, {UNION.format('hit')} SELECT * FROM uni")
def _(s, d):
    return spans.union_spans(_hits(s, d), ["video_id"])


@query("subtract_spans", f"""WITH {b.SEGMENTS}, {HITS}, {UNION.format('hit')}, h AS (SELECT video_id, start_ms AS hs, end_ms AS he FROM seg WHERE position IN (1,6)),
c AS (SELECT uni.*, hs, he, lag(he) OVER (PARTITION BY uni.video_id, start_ms ORDER BY hs) AS pe FROM uni LEFT JOIN h ON h.video_id=uni.video_id AND he > start_ms AND hs < end_ms)
SELECT * FROM (SELECT video_id, coalesce(pe, start_ms) AS start_ms, coalesce(hs, end_ms) AS end_ms FROM c UNION ALL SELECT video_id, max(he), end_ms FROM c WHERE he IS NOT NULL GROUP BY video_id, start_ms, end_ms) WHERE end_ms - start_ms >= 1000""")
def _(s, d):
    return spans.subtract_spans(spans.union_spans(_hits(s, d), ["video_id"]), _holes(s, d), ["video_id"])


@query("merge_hit_spans", f"WITH {b.SEGMENTS}, {HITS}, pad AS (SELECT video_id, greatest(start_ms-20000,0) AS start_ms, end_ms+20000 AS end_ms FROM hit), {UNION.format('pad')}, r AS (SELECT *, 60000 - coalesce(sum(end_ms-start_ms) OVER (PARTITION BY video_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS room FROM uni) SELECT video_id, start_ms, CAST(least(end_ms, start_ms+room) AS BIGINT) AS end_ms FROM r WHERE room > 1000")
def _(s, d):
    return spans.merge_hit_spans(_hits(s, d), ["video_id"], most_ms=60_000)


@query("segments_in_spans", f"WITH {b.SEGMENTS} SELECT id FROM seg WHERE EXISTS (SELECT 1 FROM seg h WHERE h.video_id=seg.video_id AND h.position IN (1,6) AND h.start_ms <= seg.end_ms AND h.end_ms >= seg.start_ms)")
def _(s, d):
    return spans.segments_in_spans(b.segments(s, d), _holes(s, d)).select("id")


@query("time_spans", f"WITH {b.SEGMENTS}, v AS (SELECT video_id, max(end_ms) AS d FROM seg GROUP BY video_id) SELECT video_id, k AS span_no, k*120000 AS start_ms, least(120000, d-k*120000) AS length_ms FROM (SELECT *, unnest(generate_series(0, d//120000)) AS k FROM v) WHERE d - k*120000 >= 50")
def _(s, d):
    v = b.segments(s, d).groupBy("video_id").agg(F.max("end_ms").alias("duration_ms")).withColumn("done_ms", F.lit(0).cast("long"))
    return spans.time_spans(v)


@query("diar_regions", f"WITH {b.SEGMENTS}, v AS (SELECT video_id, max(end_ms) AS d FROM seg GROUP BY video_id) SELECT * FROM (SELECT video_id, k AS span_no, CASE WHEN k=0 THEN 0 ELSE greatest(k*60000-20000,0) END AS start_ms, least(k*60000+60000, d) AS end_ms FROM (SELECT *, unnest(generate_series(0, d//60000)) AS k FROM v) WHERE d > k*60000) WHERE end_ms-start_ms >= 300")
def _(s, d):
    return spans.diar_regions(b.segments(s, d).groupBy("video_id").agg(F.max("end_ms").alias("duration_ms")), 60_000)


# ---- speakers

@query("assign_speakers", f"WITH {b.SEGMENTS}, {b.TURNS} SELECT seg.id, (SELECT arg_max(t.speaker, least(t.end_ms, seg.end_ms)-greatest(t.start_ms, seg.start_ms) - t.turn_no/1e7) FROM trn t WHERE t.video_id=seg.video_id AND t.start_ms < seg.end_ms AND t.end_ms > seg.start_ms) AS speaker FROM seg")
def _(s, d):
    return speakers.assign_speakers(b.segments(s, d), b.turns(s, d)).select("id", "speaker")


@query("seam_overlap", f"WITH {b.SEGMENTS}, {b.TURNS} SELECT s.video_id, s.speaker AS local, t.speaker AS global, CAST(sum(least(t.end_ms, s.end_ms)-greatest(t.start_ms, s.start_ms)) AS BIGINT) AS overlap_ms FROM seg s JOIN trn t ON t.video_id=s.video_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms GROUP BY 1,2,3")
def _(s, d):
    return speakers.seam_overlap(b.turns(s, d), b.segments(s, d))


@query("speaker_labels", f"WITH {b.SEGMENTS} SELECT video_id, label, CAST(row_number() OVER (PARTITION BY video_id ORDER BY p) AS INTEGER) AS label_no, label AS name FROM (SELECT video_id, speaker AS label, min(position) AS p FROM seg WHERE speaker IS NOT NULL GROUP BY 1,2)")
def _(s, d):
    return speakers.speaker_labels(b.segments(s, d))


@query("resolve_names", f"WITH {b.SEGMENTS}, {b.SPEAKERS} SELECT seg.id, coalesce(name, speaker, 'Без спикера') AS speaker_name FROM seg LEFT JOIN spk ON spk.video_id=seg.video_id AND label=speaker")
def _(s, d):
    return speakers.with_speaker_name(b.segments(s, d), b.speakers(s, d)).select("id", "speaker_name")


@query("hide_authors", f"WITH {b.SEGMENTS}, {b.SPEAKERS}, {b.VIDEOS} SELECT seg.id, CASE WHEN opt_diarize = false THEN NULL ELSE speaker END AS speaker, CASE WHEN opt_diarize = false THEN '' ELSE coalesce(name, speaker, 'Без спикера') END AS speaker_name FROM seg LEFT JOIN spk ON spk.video_id=seg.video_id AND label=speaker LEFT JOIN vid ON vid.video_id=seg.video_id")
def _(s, d):
    return speakers.hide_authors(speakers.with_speaker_name(b.segments(s, d), b.speakers(s, d)), b.videos(s, d)).select("id", "speaker", "speaker_name")


@query("rename_speaker", f"WITH {b.SEGMENTS}, {b.SPEAKERS} SELECT seg.video_id, position, name || ': ' || text AS embed_text FROM seg JOIN spk ON spk.video_id=seg.video_id AND label=speaker WHERE label='SPEAKER_01'")
def _(s, d):
    return speakers.rename_speakers(b.segments(s, d), b.speakers(s, d).where("label = 'SPEAKER_01'"))


# ---- text repair

@query("junctions", f"""WITH {b.SEGMENTS}, j AS (SELECT video_id, position, text, lead(text) OVER (PARTITION BY video_id ORDER BY position) AS nx FROM seg), w AS (SELECT *, {WORDS.format('text')} AS a, {WORDS.format('nx')} AS z FROM j WHERE nx IS NOT NULL),
l AS (SELECT *, lower(regexp_replace(a[-1], '[^\\p{{L}}]', '', 'g')) AS la, lower(regexp_replace(z[1], '[^\\p{{L}}]', '', 'g')) AS lz FROM w)
SELECT video_id, position, array_to_string(a[greatest(len(a)-15,1):], ' ') AS left_words, array_to_string(z[1:16], ' ') AS right_words, CASE WHEN {CLOSED.format('text')} THEN 'closed' WHEN length(la)>=6 AND length(lz)>=6 AND la<>lz AND la[1:6]=lz[1:6] THEN 'restarted' ELSE 'open' END AS verdict FROM l""")
def _(s, d):
    return repair.junctions(b.segments(s, d))


@query("clean_asr", f"WITH {b.SEGMENTS} SELECT id, trim(text, ' ') AS text FROM seg WHERE trim(text, ' ') <> ''")
def _(s, d):
    return repair.clean_asr(b.segments(s, d)).select("id", "text")


@query("shift_times", f"WITH {b.SEGMENTS}, {b.TURNS} SELECT t.video_id, t.turn_no, t.start_ms + c.a AS start_ms, t.end_ms + c.a AS end_ms FROM trn t JOIN (SELECT video_id, chunk_no, min(start_ms) AS a FROM trn GROUP BY 1,2) c USING (video_id, chunk_no)")
def _(s, d):
    t = b.turns(s, d)
    return repair.shift_times(t, t.groupBy("video_id", "chunk_no").agg(F.min("start_ms").alias("start_ms"))).select("video_id", "turn_no", "start_ms", "end_ms")


@query("case_candidates", f"""WITH {b.SEGMENTS}, w AS (SELECT video_id, position, list_transform({WORDS.format('text')}, lambda x, i: CASE WHEN i%5=3 THEN 'Щ' || x ELSE x END) AS w FROM seg), x AS (SELECT *, unnest(generate_series(1, len(w)-1)) AS i FROM w WHERE len(w) > 1)
SELECT video_id, position, i AS word_no, w[i+1] AS word, array_to_string(w[greatest(i-6,0)+1:i+5], ' ') AS fragment FROM x WHERE regexp_matches(w[i+1], '\\p{{Lu}}') AND NOT {CLOSED.format('w[i]')}""")
def _(s, d):  # every fifth word with a capital
    capital = lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("Щ"), x)).otherwise(x)
    return repair.case_candidates(b.segments(s, d).withColumn("text", F.array_join(F.transform(repair.words_of(F.col("text")), capital), " ")))


ENDS = """regexp_matches(regexp_replace({0}, '["''»)\\]}}”]+$', ''), '[.!?…]$') AND NOT list_contains(['т.д.','т.п.','т.е.','т.к.','т.н.','т.о.','др.','пр.','см.','рис.','табл.','им.','ул.','стр.','г.','гг.'], lower(regexp_replace({0}, '["''»)\\]}}”]+$', ''))) AND NOT regexp_matches(regexp_replace({0}, '["''»)\\]}}”]+$', ''), '^[A-Za-zА-Яа-яЁё]\\.$')"""


@query("split_segments", f"""WITH {b.SEGMENTS}, w AS (SELECT video_id, position, start_ms, end_ms, list_transform({WORDS.format('text')}, lambda x, i: CASE WHEN i%9=5 THEN 'т.д.' WHEN i%11=8 THEN 'А.' WHEN i%13=9 THEN x || '!»' ELSE x END) AS w FROM seg), x AS (SELECT video_id, position, start_ms, end_ms, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM w),
n AS (SELECT *, coalesce(sum(({ENDS.format('word')})::INT) OVER (PARTITION BY video_id, position ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM x),
m AS (SELECT *, max(no) OVER (PARTITION BY video_id, position) >= 4 AS cut FROM n),
p AS (SELECT video_id, position, start_ms AS a, end_ms AS z, cut, CASE WHEN cut THEN no//4 ELSE 0 END AS piece_no, string_agg(word, ' ' ORDER BY i) AS text, min(i) - 1 AS i0, max(i) - 1 AS i1 FROM m GROUP BY ALL),
t AS (SELECT *, sum(length(text)) OVER (PARTITION BY video_id, position ORDER BY piece_no) AS c, sum(length(text)) OVER (PARTITION BY video_id, position) AS al FROM p)
SELECT video_id, position, CAST(piece_no AS BIGINT) AS piece_no, text, CAST(CASE WHEN NOT cut THEN a WHEN position%2=1 THEN a + i0*300 ELSE a + (z-a)*(c-length(text))//al END AS BIGINT) AS start_ms, CAST(CASE WHEN NOT cut THEN z WHEN position%2=1 THEN a + i1*300 + 250 ELSE a + (z-a)*c//al END AS BIGINT) AS end_ms, CASE WHEN position%2=1 THEN i1-i0+1 ELSE 0 END AS n_words FROM t""")
def _(s, d):  # with abbreviations, initials and quotes; the words of every second turn have times
    odd = lambda x, i: F.when(i % 9 == 4, "т.д.").when(i % 11 == 7, "А.").when(i % 13 == 8, F.concat(x, F.lit("!»"))).otherwise(x)
    seg = b.segments(s, d).withColumn("w", F.transform(repair.words_of(F.col("text")), odd)).withColumn("text", F.array_join("w", " ")).where("text <> ''")
    timed = F.transform("w", lambda x, i: F.struct(x.alias("text"), (F.col("start_ms") + i * 300).alias("start_ms"), (F.col("start_ms") + i * 300 + 250).alias("end_ms")))
    cut = repair.split_segments(seg.withColumn("words", F.when(F.col("position") % 2 == 1, timed)))
    return cut.select("video_id", "position", "piece_no", "text", "start_ms", "end_ms", F.size("words").cast("long").alias("n_words"))


@query("prepare_store", f"WITH {b.SEGMENTS} SELECT id, row_number() OVER (PARTITION BY video_id ORDER BY position) - 1 AS position, coalesce(speaker || ': ', '') || trim(text, ' ') AS embed_text FROM seg WHERE trim(text, ' ') <> ''")
def _(s, d):
    return repair.prepare_store(b.segments(s, d)).select("id", "position", "embed_text")


@query("clock", f"WITH {b.SEGMENTS} SELECT id, {CLOCK.format('(start_ms*37//1000)')} AS mark FROM seg")
def _(s, d):
    return b.segments(s, d).select("id", f.clock(F.col("start_ms") * 37 / 1000).alias("mark"))


@query("sentence_closed", f"WITH {b.SEGMENTS} SELECT id, {CLOSED.format('text')} AS closed FROM seg")
def _(s, d):
    return b.segments(s, d).select("id", f.sentence_closed(F.col("text")).alias("closed"))


@query("clip", f"WITH {b.SEGMENTS}, t AS (SELECT id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM seg) SELECT id, CASE WHEN length(t) > 40 THEN rtrim(t[1:39], ' ') || '…' ELSE t END AS clipped FROM t")
def _(s, d):
    return b.segments(s, d).select("id", f.clip(F.col("text"), 40).alias("clipped"))


@query("speaker_hue", f"WITH {b.SEGMENTS} SELECT DISTINCT speaker, list_reduce(list_prepend(0, list_transform(string_split(speaker, ''), lambda c: ord(c))), lambda h, c: (h*33+c)%360) AS hue FROM seg WHERE speaker IS NOT NULL")
def _(s, d):
    return b.segments(s, d).where("speaker is not null").select("speaker", f.speaker_hue(F.col("speaker")).alias("hue")).distinct()


# ---- library

@query("upsert_stage_times", f"WITH {b.DELTAS} SELECT video_id, stage, CASE WHEN stage='fetching' THEN max(seconds) ELSE sum(seconds) END AS seconds FROM del GROUP BY 1,2")
def _(s, d):
    t = b.stage_deltas(s, d)
    return library.merge_stage_times(t.where("seconds < 25"), t.where("seconds >= 25"))


@query("queue_place", f"WITH {b.VIDEOS} SELECT vid.video_id, place FROM vid LEFT JOIN (SELECT video_id, row_number() OVER (ORDER BY created_at, video_id) AS place FROM vid WHERE status NOT IN ('ready','error')) p ON p.video_id=vid.video_id")
def _(s, d):
    return library.queue_place(b.videos(s, d)).select("video_id", "place")


@query("stage_durations", f"""WITH {b.DELTAS}, {b.VIDEOS}, r AS (SELECT video_id, stage, CAST(seconds AS DOUBLE) AS seconds FROM del WHERE video_id IN (SELECT video_id FROM vid) UNION ALL SELECT video_id, status, epoch(TIMESTAMP '1996-06-01') - epoch(stage_started_at) FROM vid WHERE status = 'transcribing' AND stage_started_at IS NOT NULL),
g AS (SELECT video_id, stage, sum(seconds) AS seconds FROM r GROUP BY 1,2) SELECT *, sum(seconds) OVER (PARTITION BY video_id) AS processed_sec FROM g WHERE seconds > 0""")
def _(s, d):
    return library.stage_durations(b.videos(s, d), b.stage_deltas(s, d), F.lit(NOW).cast("timestamp"))


@query("stage_flags", f"WITH {b.VIDEOS} SELECT video_id, coalesce(opt_diarize, true) AS diarizing, coalesce(opt_merge, true) AS merging, coalesce(opt_correct, true) AS correcting, coalesce(opt_diarize, true) AS naming FROM vid")
def _(s, d):
    return library.stage_flags(b.videos(s, d))


@query("pick_format", f"WITH {b.FORMATS} SELECT video_id, format_id, height, CAST(fps AS DOUBLE) AS fps, vcodec, filesize FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY height < 720, abs(height-720), fps, CASE vcodec WHEN 'avc1' THEN 0 WHEN 'vp9' THEN 1 WHEN 'hev1' THEN 2 ELSE 3 END, filesize, format_id) AS r FROM fmt) WHERE r = 1")
def _(s, d):
    return library.pick_format(b.formats(s, d)).select("video_id", "format_id", "height", "fps", "vcodec", "filesize")


@query("pick_format_with_sound", """WITH f AS (SELECT l_orderkey AS video_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS format_id, CASE WHEN l_orderkey%4=0 OR l_partkey%6=0 THEN NULL ELSE [360,480,720,1080][l_partkey%4+1] END AS height, [NULL,960,1280,1920][l_suppkey%4+1] AS width,
  CASE WHEN l_orderkey%4=0 OR l_partkey%6=0 THEN 'none' ELSE ['AVC3.64001f','vp09','hvc1.1','av01.0','theora'][l_suppkey%5+1] END AS vcodec, CASE WHEN l_partkey%3=0 THEN 'none' ELSE 'mp4a' END AS acodec, CASE WHEN l_partkey%5=0 THEN 0 ELSE l_suppkey%3*30 END AS fps,
  CASE WHEN l_suppkey%3=0 THEN CAST(l_extendedprice AS DOUBLE) END AS filesize, CASE WHEN l_suppkey%3=1 THEN l_partkey*10 END AS filesize_approx, l_quantity AS tbr, CASE WHEN l_orderkey%7<>0 THEN 60 END AS duration_sec FROM lineitem),
s AS (SELECT *, coalesce(height,0) > 0 AND vcodec <> 'none' AS pic, coalesce(CASE WHEN filesize > 0 THEN filesize END, CASE WHEN filesize_approx > 0 THEN filesize_approx END, CASE WHEN tbr > 0 THEN CAST(tbr AS DOUBLE)*1000/8*duration_sec END) AS size, CASE WHEN fps > 0 THEN fps ELSE 30 END AS f,
  CASE lower(string_split(vcodec, '.')[1]) WHEN 'avc3' THEN 0 WHEN 'vp09' THEN 1 WHEN 'av01' THEN 3 ELSE 2 END AS cost, CASE WHEN width > 0 AND height > 0 THEN width*height ELSE height*height END AS px FROM f)
SELECT video_id, format_id, NOT pic AS audio_only, pic AND acodec='none' AS needs_audio FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY NOT pic, CASE WHEN pic THEN CAST(height<720 AS INT) END, CASE WHEN pic THEN abs(height-720) END, CASE WHEN pic THEN f END, CASE WHEN pic THEN cost END, CASE WHEN pic THEN px END, size IS NULL, size, format_id) AS r FROM s WHERE pic OR (vcodec='none' AND acodec<>'none')) WHERE r = 1""")
def _(s, d):  # with sound alone in every fourth video, unknown sizes, codecs in all spellings
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    o, p, u = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    sound = (o % 4 == 0) | (p % 6 == 0)
    x = b.table(s, d, "lineitem").select(
        o.alias("video_id"), F.concat_ws("-", p, u, F.col("l_linenumber")).alias("format_id"), F.when(~sound, at((360, 480, 720, 1080), p % 4)).alias("height"), at((None, 960, 1280, 1920), u % 4).alias("width"),
        F.when(sound, "none").otherwise(at(("AVC3.64001f", "vp09", "hvc1.1", "av01.0", "theora"), u % 5)).alias("vcodec"), F.when(p % 3 == 0, "none").otherwise("mp4a").alias("acodec"), F.when(p % 5 == 0, 0).otherwise(u % 3 * 30).alias("fps"),
        F.when(u % 3 == 0, F.col("l_extendedprice").cast("double")).alias("filesize"), F.when(u % 3 == 1, p * 10).alias("filesize_approx"), F.col("l_quantity").alias("tbr"), F.when(o % 7 != 0, 60).alias("duration_sec"),
    )
    return library.pick_format(x).select("video_id", "format_id", "audio_only", "needs_audio")


@query("default_flags", "SELECT l_orderkey AS video_id, l_linenumber AS n, CASE WHEN l_partkey%5=0 THEN NULL ELSE l_partkey - 60 END AS sec, coalesce(CASE WHEN l_partkey%5<>0 THEN l_partkey - 60 > 0 AND (l_partkey-60)*60 < 5400 END, false) AS opt_diarize FROM lineitem")
def _(s, d):
    sec = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") - 60)
    return b.table(s, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("n"), sec.alias("sec"), library.default_flags(sec * 60)["opt_diarize"].alias("opt_diarize"))


@query("stages_in_order", f"""WITH {b.DELTAS}, g AS (SELECT video_id, CASE WHEN stage='storing' THEN 'other' ELSE stage END AS stage, CAST(sum(seconds) AS DOUBLE) AS seconds FROM del GROUP BY 1, 2)
SELECT video_id, string_agg(stage, ' ' ORDER BY list_position(['compressing','storing','transcribing','diarizing','merging','correcting','splitting','embedding','moments','naming'], stage) NULLS LAST, stage) AS stages, sum(seconds) AS processed_sec FROM g GROUP BY 1""")
def _(s, d):
    stage = F.when(F.col("stage") == "storing", "other").otherwise(F.col("stage"))
    g = b.stage_deltas(s, d).groupBy("video_id", stage.alias("stage")).agg(F.sum("seconds").cast("double").alias("seconds"))
    return library.stages_in_order(g).select("video_id", F.array_join(F.transform("stages", lambda x: x["stage"]), " ").alias("stages"), "processed_sec")


@query("load_seconds", f"WITH {b.VIDEOS}, {b.DELTAS}, g AS (SELECT video_id, sum(seconds) AS s FROM del WHERE video_id%3=0 GROUP BY 1) SELECT vid.video_id, CAST(coalesce(s, processed_sec, CASE WHEN NOT held AND status <> 'queued' THEN CASE WHEN started_at IS NOT NULL THEN greatest(0, epoch(TIMESTAMP '1996-06-01') - epoch(started_at)) END END) AS DOUBLE) AS load_sec FROM vid LEFT JOIN g USING (video_id)")
def _(s, d):  # two of three videos have no stage times
    return library.load_seconds(b.videos(s, d), b.stage_deltas(s, d).where("video_id % 3 = 0"), F.lit(NOW).cast("timestamp")).withColumn("load_sec", F.col("load_sec").cast("double"))


@query("storage_usage", f"""WITH {b.SEGMENTS}, {b.VECTORS}, u AS (SELECT video_id, strlen(text) AS t, 0 AS v, 0 AS i, 0 AS m, 0 AS k FROM seg UNION ALL SELECT video_id, 0, CASE WHEN embedding IS NOT NULL THEN 4*len(embedding)+8 ELSE 0 END, 0, 0, 0 FROM vec
UNION ALL SELECT video_id, 0, 0, strlen(text) + CASE WHEN embedding IS NOT NULL THEN 4*len(embedding)+8 ELSE 0 END, 0, 0 FROM vec UNION ALL SELECT video_id, strlen(text) + 2, 0, 0, 0, 0 FROM seg
UNION ALL SELECT page_id, 0, 0, 0, CASE WHEN page_id%2=0 THEN length(html) ELSE 0 END, CASE WHEN page_id%2=0 THEN 0 ELSE length(html) END FROM pages)
SELECT video_id, CAST(sum(t) AS BIGINT) AS text_bytes, CAST(sum(v) AS BIGINT) AS vector_bytes, CAST(sum(i) AS BIGINT) AS index_bytes, CAST(sum(m) AS BIGINT) AS media_bytes, CAST(sum(k) AS BIGINT) AS work_bytes, CAST(sum(t)+sum(v)+sum(i)+sum(m)+sum(k) AS BIGINT) AS total_bytes FROM u GROUP BY 1""")
def _(s, d):
    seg, vec, files = b.segments(s, d), b.vectors(s, d), b.table(s, d, "pages")
    chats = seg.select("video_id", F.col("text").alias("content"), F.lit("[]").alias("citations"))
    media = files.select(F.col("page_id").alias("video_id"), F.when(F.col("page_id") % 2 == 0, "media").otherwise("work").alias("area"), F.length("html").cast("long").alias("bytes"))
    return library.storage_usage(seg, vec, vec, chats, media)


@query("stale_tasks", """WITH t AS (SELECT event_id AS task_id, user_id AS video_id, CASE event_id%3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'queued' END AS status, epoch(ts) - CASE WHEN event_id%2=0 THEN 86400 ELSE 0 END AS beat, epoch(ts) + event_id%1800 AS now FROM events)
SELECT task_id, o_orderkey IS NULL AS gone, coalesce(o_orderkey%11=0, false) AS held, coalesce(status = 'running' AND now - beat > 900 AND o_orderkey IS NOT NULL AND NOT o_orderkey%11=0, false) AS stale FROM t LEFT JOIN orders ON o_orderkey = video_id""")
def _(s, d):
    ts = F.col("ts").cast("timestamp")
    beat = F.when(F.col("event_id") % 2 == 0, ts - F.expr("interval 1 day")).otherwise(ts)
    status = F.element_at(F.array(F.lit("running"), F.lit("done"), F.lit("queued")), (F.col("event_id") % 3 + 1).cast("int"))
    t = b.table(s, d, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("video_id"), status.alias("status"), beat.alias("heartbeat_at"), (ts.cast("double") + F.col("event_id") % 1800).alias("now"))
    return library.stale_tasks(t, b.videos(s, d).select("video_id", "held"), F.col("now")).select("task_id", "gone", "held", "stale")


@query("pending_links", f"WITH {b.VIDEOS} SELECT video_id, source_url FROM vid WHERE status = 'transcribing' AND NOT held")
def _(s, d):  # those that transcribe stand for those that fetch
    v = b.videos(s, d).withColumn("status", F.when(F.col("status") == "transcribing", "fetching").otherwise(F.col("status")))
    return library.pending_links(v).select("video_id", "source_url")


@query("latest_version", "SELECT p_size AS key, arg_max(p_partkey%50 || '.' || p_partkey%7, (p_partkey%50)*1000 + p_partkey%7) AS version FROM part GROUP BY 1")
def _(s, d):
    k = F.col("p_partkey")
    return library.latest_version(b.table(s, d, "part").select(F.col("p_size").alias("key"), F.concat_ws(".", (k % 50).cast("string"), (k % 7).cast("string")).alias("version")), ["key"])


@query("latest_version_of_any_length", "SELECT p_size AS key, arg_max('2026' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || '.b' || p_partkey%7 || 'c1-rc', CAST(p_partkey AS BIGINT)) AS version FROM part GROUP BY 1")
def _(s, d):  # dates of 14 digits, letters among the digits
    k = F.col("p_partkey")
    v = F.concat(F.lit("2026"), F.lpad(k.cast("string"), 10, "0"), F.lit(".b"), (k % 7).cast("string"), F.lit("c1-rc"))
    return library.latest_version(b.table(s, d, "part").select(F.col("p_size").alias("key"), v.alias("version")), ["key"])


@query("missing_entry_embeddings", "SELECT vec_id AS id, 'Ответ \"' || vec_id || '\"' || chr(10) || 'и дальше' AS embed_text FROM embeddings WHERE vec_id%17=0 AND label <> 9")
def _(s, d):
    return library.missing_entry_embeddings(_entries(s, d), _indexes(s, d)).select("id", "embed_text")


@query("keep_latest_events", "SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 3001")
def _(s, d):
    return library.keep_latest(b.job_events(s, d)).select("id")


@query("link_inventory", r"WITH u AS (SELECT page_id, trim(regexp_replace(url, '\s+', ' ', 'g'), ' ') AS url FROM pages) SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://(?:[^@/]*@)?([^/:?#\s]+)', 1), '^www\.', '')[1:180] AS title FROM u WHERE regexp_matches(url, '^https?://[^/\s?#]+') AND length(url) <= 2000")
def _(s, d):
    return library.link_inventory(b.table(s, d, "pages").select("page_id", "url")).select("page_id", "url", "title")


@query("media_inventory", """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS file_id, 'Talk ' || page_id || ['.mp4','.MKV','.mp3','.txt','.m4a','.webm','.wav','.pdf'][page_id%8+1] AS nm, length(html)*(page_id%9) AS len, ['video','video','audio','rejected','audio','video','audio','rejected'][page_id%8+1] AS k FROM pages), q AS (SELECT *, CASE WHEN len <= 0 THEN 'rejected' ELSE k END AS kind FROM p)
SELECT file_id, kind, regexp_replace(nm, '\\.[^.]*$', '') AS title, nm AS original_name, CASE kind WHEN 'video' THEN 'videos/' || file_id || '.mp4' WHEN 'audio' THEN 'videos/' || file_id || '.m4a' END AS object_key FROM q""")
def _(s, d):
    suffix = F.element_at(F.array(*map(F.lit, (".mp4", ".MKV", ".mp3", ".txt", ".m4a", ".webm", ".wav", ".pdf"))), (F.col("page_id") % 8 + 1).cast("int"))
    p = b.table(s, d, "pages")
    return library.media_inventory(p.select(F.col("page_id").cast("string").alias("file_id"), F.concat(F.lit("/in/Talk "), "page_id", suffix).alias("path"), (F.length("html") * (F.col("page_id") % 9)).alias("length")))


@query("index_catalog", "WITH i AS (SELECT DISTINCT label AS video_id, label*2+vec_id%2 AS index_id FROM embeddings) SELECT video_id, index_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN index_id%3=0 THEN 0 ELSE 1 END, index_id*7%5, index_id) AS INTEGER) AS place FROM i WHERE index_id%3<>2")
def _(s, d):
    return library.index_catalog(_indexes(s, d)).select("video_id", "index_id", "place")


@query("pending_work", f"WITH {b.VIDEOS} SELECT DISTINCT label*2+vec_id%2 AS index_id FROM embeddings WHERE label%2=1 AND label IN (SELECT video_id FROM vid WHERE status IN ('ready', 'queued'))")
def _(s, d):  # indexes of every second video are still built
    i = _indexes(s, d).withColumn("status", F.when(F.col("video_id") % 2 == 1, "building").otherwise("ready"))
    v = b.videos(s, d).withColumn("status", F.when(F.col("status") == "queued", "ready").otherwise(F.col("status")))
    return library.pending_builds(i, v).select("index_id")


@query("purge_videos", f"WITH {b.SEGMENTS} SELECT id FROM seg WHERE video_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey%11=0)")
def _(s, d):
    return library.purge(b.segments(s, d), b.videos(s, d).where("held")).select("id")


@query("pending_pieces", f"WITH {b.SEGMENTS}, {b.TURNS} SELECT video_id, turn_no AS piece_no FROM trn WHERE NOT (turn_no%3=0 AND video_id%2=0)")
def _(s, d):
    p = b.turns(s, d).select("video_id", F.col("turn_no").alias("piece_no"))
    return library.pending_pieces(p, p.where("piece_no % 3 = 0 and video_id % 2 = 0"))


@query("resume_prefix", f"""WITH {b.SEGMENTS}, {b.TURNS}, p AS (SELECT video_id, turn_no, (video_id*31+turn_no*7)%10 AS len FROM trn), g AS (SELECT video_id, coalesce(min(CASE WHEN len=0 THEN turn_no END), count(*)) AS kept, count(*) AS n FROM p GROUP BY 1)
SELECT video_id, kept, CASE WHEN kept < n THEN kept*20000 ELSE 777 END AS done_ms FROM g""")
def _(s, d):
    p = b.turns(s, d).select("video_id", F.col("turn_no").alias("piece_no"), F.concat_ws("/", "video_id", "turn_no").alias("path"), F.lit(777).cast("long").alias("done_ms"))
    files = p.select("path", ((F.col("video_id") * 31 + F.col("piece_no") * 7) % 10).alias("length"))
    return library.resume_prefix(p, files, 20_000)


@query("uniqueness_report", f"""WITH {b.VIDEOS}, i AS (SELECT label AS video_id, label*2+vec_id%2 AS index_id FROM embeddings) SELECT 'segment position' AS rule, conv_id || '/' || turn AS key, count(*) AS n FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1
UNION ALL SELECT 'speaker label', CAST(conv_id AS VARCHAR) || '/' || role, count(*) FROM conversations GROUP BY conv_id, role HAVING count(*) > 1
UNION ALL SELECT 'index name', video_id || '/' || index_id, count(*) FROM i GROUP BY video_id, index_id HAVING count(*) > 1 UNION ALL SELECT 'one moments index', CAST(video_id AS VARCHAR), count(*) FROM i WHERE index_id%3=0 GROUP BY video_id HAVING count(*) > 1
UNION ALL SELECT 'one live fetch', source_url, count(*) FROM vid WHERE status = 'queued' GROUP BY source_url HAVING count(*) > 1""")
def _(s, d):
    c = b.table(s, d, "conversations")
    i = _entries(s, d).select("video_id", F.col("index_id").cast("string").alias("name"), F.when(F.col("index_id") % 3 == 0, "moments").otherwise("custom").alias("kind"))
    v = b.videos(s, d).withColumn("status", F.when(F.col("status") == "queued", "fetching").otherwise(F.col("status")))
    return library.uniqueness_report(c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("position")), c.select(F.col("conv_id").alias("video_id"), F.col("role").alias("label")), i, v)


@query("missing_embeddings", f"WITH {b.VIDEOS} SELECT vec_id AS id FROM embeddings WHERE vec_id%17=0 AND label IN (SELECT video_id FROM vid WHERE status='ready')")
def _(s, d):
    return library.missing_embeddings(b.vectors(s, d), b.videos(s, d)).select("id")


@query("recent_messages", "SELECT conv_id, turn, CAST(r AS INTEGER) AS back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def _(s, d):
    return library.recent_messages(b.table(s, d, "conversations")).select("conv_id", "turn", "back")


@query("needs_summary", "SELECT conv_id, coalesce(sum(CASE WHEN r > 4 THEN length(text) END), 0) > 600 AS needs_summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY conv_id")
def _(s, d):
    return library.needs_summary(b.table(s, d, "conversations"), limit=600)


@query("stage_fraction", f"WITH {b.DELTAS}, x AS (SELECT video_id, stage, seconds, seconds/50 AS o FROM del), e AS (SELECT *, CASE stage WHEN 'compressing' THEN 0.0 WHEN 'storing' THEN 0.15 WHEN 'transcribing' THEN 0.19 WHEN 'diarizing' THEN 0.61 WHEN 'merging' THEN 0.73 WHEN 'correcting' THEN 0.85 END::DOUBLE AS a, CASE stage WHEN 'compressing' THEN 0.15 WHEN 'storing' THEN 0.19 WHEN 'transcribing' THEN 0.61 WHEN 'diarizing' THEN 0.73 WHEN 'merging' THEN 0.85 WHEN 'correcting' THEN 0.92 END::DOUBLE AS z FROM x) SELECT video_id, stage, round(CASE WHEN a IS NOT NULL THEN least(1.0, greatest(0.0, (o-a)/(z-a)))*100 END, 3) AS percent FROM e")
def _(s, d):
    t = b.stage_deltas(s, d).withColumn("overall", F.col("seconds") / 50)
    return library.stage_fraction(t).select("video_id", "stage", "percent")


_COUNTS = "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1,2"
_GAPS = "WITH m AS (SELECT user_id AS video_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 900 SECOND THEN 0 ELSE 1 END AS nw FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT video_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY video_id, s"


@query("event_counts", _COUNTS)
def _(s, d):
    return library.event_counts(b.job_events(s, d))


@query("heartbeat_gaps", _GAPS)
def _(s, d):
    return library.heartbeat_sessions(b.job_events(s, d))
