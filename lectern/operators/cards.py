"""Topics, cards, listings and scopes: rows of a topic as text, model answers as rows, spans a question may use."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, clip_words, clock, parse_range, sentence_closed, squeezed
from .library import recent_messages
from .spans import merge_hit_spans, overlap_join, union_spans

MARK = r"(\d{1,2}:\d{2}:\d{2}|\d{1,3}:\d{2})"
#: Roles of a model's places: where to answer, what to leave out, what the question names.
ONLY, SKIP, SUBJECT = "only", "skip", "subject"


def stamp(start_ms: Column, end_ms: Column) -> Column:
    return F.concat(F.lit("["), clock(start_ms / 1000), F.lit("–"), clock(end_ms / 1000), F.lit("]"))


def spoken(speaker: Column) -> Column:
    """A row as "[m:ss] who: text"."""
    who = F.trim(F.coalesce(speaker, F.lit("")))
    return F.concat(F.lit("["), clock(F.col("start_ms") / 1000), F.lit("] "), F.when(who != "", F.concat(who, F.lit(": "))).otherwise(""), F.col("text"))


def _lines(order: list[str], line: Column, sep: str = "\n") -> Column:
    told = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return F.array_join(F.transform(told, lambda x: x["_line"]), sep)


def bound_topics(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """keys, part, start_ms, end_ms: a topic ends where the next one starts; the last, and one that would be empty, at its own end."""
    own = rows.groupBy(*keys, part).agg(F.min_by("start_ms", "position").alias("start_ms"), F.max_by("end_ms", "position").alias("_own"))
    after = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy(part))
    return own.withColumn("_next", after).select(*keys, part, "start_ms", F.when(F.col("_next") > F.col("start_ms"), F.col("_next")).otherwise(F.col("_own")).alias("end_ms"))


def topic_body(rows: DataFrame, keys: list[str], most: int = 12_000, head: int = 7000, tail: int = 4000) -> DataFrame:
    """keys, body: the spoken lines of a part; of a longer one the first `head` and last `tail` characters.

    Lines that are in neither are left out before they are gathered, so a part's gathered text is bounded.
    """
    lines = rows.select(*keys, "position", spoken(F.col("speaker")).alias("_l")).withColumn("_n", F.length("_l") + 1)
    w = Window.partitionBy(*keys).orderBy("position", "_l")
    upto = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("_to", upto).join(lines.groupBy(*keys).agg((F.sum("_n") - 1).alias("_all")), keys)
    long = F.col("_all") > most
    # a line that starts right after the head brings the head's last character, a line end
    kept = lines.where(~long | (F.col("_to") - F.col("_n") <= head) | (F.col("_to") > F.col("_all") - tail))
    front = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~long | (F.col("_to") - F.col("_n") <= head), F.struct("position", "_l")))), lambda x: x["_l"]), "\n")
    back = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(long & (F.col("_to") > F.col("_all") - tail), F.struct("position", "_l")))), lambda x: x["_l"]), "\n")
    cut = F.concat(F.substring("front", 1, head), F.lit("\n...\n"), F.right(F.col("back"), F.lit(tail)))
    got = kept.groupBy(*keys).agg(front.alias("front"), back.alias("back"), F.max("_all").alias("_all"))
    return got.select(*keys, F.when(F.col("_all") <= most, F.col("front")).otherwise(cut).alias("body"))


def blurb(rows: DataFrame, keys: list[str], head: int = 240, tail: int = 180) -> DataFrame:
    """keys, blurb: "m:ss–m:ss first two lines … last line" of an atom."""
    line = F.struct("position", "start_ms", "end_ms", spoken(F.col("speaker")).alias("line"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    some = rows.select(*keys, line.alias("r"), place.alias("_p")).groupBy(*keys).agg(
        F.min_by("r", "_p").alias("first"), F.max_by("r", "_p").alias("last"), F.max(F.when(F.col("_p") == 2, F.col("r.line"))).alias("second")
    )
    said = F.substring(F.concat_ws(" ", "first.line", "second"), 1, head)
    mark = F.concat(clock(F.col("first.start_ms") / 1000), F.lit("–"), clock(F.col("last.end_ms") / 1000))
    return some.select(*keys, F.concat(mark, F.lit(" "), said, F.lit(" … "), F.substring("last.line", 1, tail)).alias("blurb"))


ITEM = "array<struct<title string, text string, start string, end string>>"


def parse_items(answer: Column) -> Column:
    """The list between the first [ and the last ] of a model's answer, as ITEM; null if there is none."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), ITEM)


def parse_object(answer: Column) -> Column:
    """What lies between the first { and the last }, as a map of strings; null if it isn't an object."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "map<string,string>")


def parse_numbers(answer: Column) -> Column:
    """The whole numbers of the list between the first [ and the last ]."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\[[^\]]*\])", 1), "array<bigint>")


def _seconds(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.trim(text), r"^\[+|\]+$", ""), ":")
    return F.when(F.forall(parts, lambda p: p.try_cast("double").isNotNull()), F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double")))


def keep_items(answers: DataFrame, most: int = 8, limit: int = 400) -> DataFrame:
    """w_id, place, start, end, text: the first items of each answer (w_id, answer, win_start, win_end in seconds).

    Titles go before texts; times are held inside the window; rows without words are dropped.
    """
    items = answers.select("w_id", "win_start", "win_end", F.posexplode(F.slice(parse_items(F.col("answer")), 1, most)).alias("n", "item"))
    title, text = squeezed(F.coalesce("item.title", F.lit(""))), squeezed(F.coalesce("item.text", F.lit("")))
    whole = F.when((title != "") & (text != ""), F.concat(title, F.lit(". "), text)).otherwise(F.concat(title, text))
    held = lambda x, low: F.least(F.greatest(x, low), F.col("win_end"))
    k = items.withColumn("text", whole).where("text <> ''").withColumn("start", held(F.coalesce(_seconds(F.col("item.start")), F.col("win_start")), F.col("win_start")))
    k = k.withColumn("end", held(F.coalesce(_seconds(F.col("item.end")), F.col("win_end")), F.col("start")))
    place = F.row_number().over(Window.partitionBy("w_id").orderBy("start", "end", "n"))
    return k.select("w_id", place.alias("place"), "start", "end", F.substring("text", 1, limit).alias("text"))


def concrete(items: DataFrame, vague: str, least: int = 240) -> DataFrame:
    """key, start_ms, end_ms, text: without short items that match the pattern `vague`; equal neighbours are one."""
    kept = items.where(~((F.length("text") < least) & F.col("text").rlike(vague)))
    w = Window.partitionBy("key").orderBy("start_ms", "end_ms")
    new = F.when(F.col("text").eqNullSafe(F.lag("text").over(w)), 0).otherwise(1)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = kept.withColumn("_new", new).withColumn("_island", island)
    return marked.groupBy("key", "_island", "text").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")


def topics_overview(topics: DataFrame) -> DataFrame:
    """video_id, text: one card that lists a video's topics (topic_no, title, start_ms, end_ms)."""
    line = F.concat((F.col("topic_no") + 1).cast("string"), F.lit(". "), "title", F.lit(" ("), clock(F.col("start_ms") / 1000), F.lit("–"), clock(F.col("end_ms") / 1000), F.lit(")"))
    return topics.groupBy("video_id").agg(F.concat(F.lit("Темы этого видео:\n"), _lines(["topic_no"], line)).alias("text"))


def index_listing(entries: DataFrame, rows: int = 120, card: int = 420, summary: int = 3000, most: int = 9000) -> DataFrame:
    """index_id, listing: an index (index_id, id, start_ms, end_ms, text) read as text.

    Cards of half the covered time or more keep their lines; the listing stops before `most` characters and says how
    many cards are left.
    """
    place = F.row_number().over(Window.partitionBy("index_id").orderBy("start_ms", "id"))
    first = entries.withColumn("place", place).where(F.col("place") <= rows)
    ends = first.groupBy("index_id").agg((F.max("end_ms") - F.min("start_ms")).alias("covered"), F.count("*").alias("n"))
    e = first.join(ends, "index_id")
    whole = (F.col("covered") > 0) & ((F.col("end_ms") - F.col("start_ms")) * 2 >= F.col("covered"))
    parts = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    long = F.array_join(F.transform(parts, lambda p: clip(p, card)), "\n")
    long = F.when(F.length(long) <= summary, long).otherwise(F.concat(F.rtrim(F.substring(long, 1, summary - 1)), F.lit("…")))
    line = F.concat(stamp(F.col("start_ms"), F.col("end_ms")), F.lit(" "), F.when(whole, long).otherwise(clip(F.col("text"), card)))
    used = F.sum(F.length("line")).over(Window.partitionBy("index_id").orderBy("place"))
    fits = e.withColumn("line", line).withColumn("used", used).withColumn("line", F.when(F.col("used") <= most, F.col("line")))
    told = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), lambda x: x.isNotNull())
    read = fits.groupBy("index_id").agg(told.alias("lines"), F.max("n").alias("n"))
    more = F.concat(F.lit("…и ещё "), (F.col("n") - F.size("lines")).cast("string"), F.lit(" пунктов, ищи их через поиск по индексу"))
    return read.select("index_id", F.array_join(F.when(F.size("lines") < F.col("n"), F.concat("lines", F.array(more))).otherwise(F.col("lines")), "\n").alias("listing"))


def span_read(spans: DataFrame, cards: DataFrame, segments: DataFrame, most_ms: int = 1_800_000, rows: int = 40) -> DataFrame:
    """w_id, kind (card / segment), place, id of what a span (w_id, video_id, start_ms, end_ms) holds.

    Spans are cut to 30 minutes. Cards touch it by more than an end, but for those that cover it and are over twice as
    long; segments touch it, ends included, the first 40 by position.
    """
    s = spans.withColumn("end_ms", F.least("end_ms", F.col("start_ms") + most_ms)).where("end_ms > start_ms")
    met = overlap_join(s, cards.select("video_id", "id", "start_ms", "end_ms"))
    over = (F.col("r_start_ms") <= F.col("start_ms")) & (F.col("r_end_ms") >= F.col("end_ms")) & (F.col("r_end_ms") - F.col("r_start_ms") > 2 * (F.col("end_ms") - F.col("start_ms")))
    rank = lambda *by: F.row_number().over(Window.partitionBy("w_id").orderBy(*by))
    c = met.where(~over).select("w_id", F.lit("card").alias("kind"), rank("r_start_ms", "r_id").alias("place"), F.col("r_id").alias("id"))
    said = overlap_join(s, segments.select("video_id", "id", "position", "start_ms", "end_ms"), inclusive=True)
    return c.union(said.select("w_id", F.lit("segment"), rank("r_position").alias("place"), "r_id").where(F.col("place") <= rows))


def _met(spans: Column, others: Column, least_ms: int = 1) -> Column:
    """What two lists of spans (a, z) share, in order; pieces shorter than least_ms are dropped."""
    both = lambda x: F.transform(others, lambda y: F.struct(F.greatest(x["a"], y["a"]).alias("a"), F.least(x["z"], y["z"]).alias("z")))
    return F.filter(F.flatten(F.transform(spans, both)), lambda x: x["z"] - x["a"] >= least_ms)


def _gaps(spans: Column, end: Column) -> Column:
    """What lies before, between and after spans in order that don't touch."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["z"]))
    return F.zip_with(starts, F.concat(F.transform(spans, lambda x: x["a"]), F.array(end)), lambda a, z: F.struct(a.alias("a"), z.alias("z")))


def _listed(spans: DataFrame, name: str, when: Column | None = None) -> Column:
    span = F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("z"))
    return F.array_sort(F.collect_list(span if when is None else F.when(when, span))).alias(name)


def resolve_places(places: DataFrame, videos: DataFrame, share: float = 0.9) -> DataFrame:
    """q_id, kind (range / skip / subject), start_ms, end_ms: where a question may be answered.

    places: q_id, video_id, role, start_ms, end_ms (null: open); videos: video_id, duration_ms. The allowed area is what
    `only` names (else the video) without what `skip` names; where nothing would be left, skip is ignored. The subject
    is its first place shorter than `share` of the video. A question without a range row may use all of its video.
    A question's places are the few that a model has named, so they make one row's lists.
    """
    p = places.join(videos.select("video_id", "duration_ms"), "video_id").withColumn("end_ms", F.least(F.coalesce("end_ms", "duration_ms"), "duration_ms")).where("start_ms < duration_ms and end_ms > start_ms")
    u = union_spans(p, ["q_id", "duration_ms", "role"])
    short = F.col("end_ms") - F.col("start_ms") < share * F.col("duration_ms")
    of = lambda role, also=F.lit(True): _listed(u, role, (F.col("role") == role) & also)
    q = u.groupBy("q_id", "duration_ms").agg(of(ONLY), of(SKIP), of(SUBJECT, short))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("duration_ms").alias("z")))
    rest = _met(F.when(F.size(ONLY) > 0, F.col(ONLY)).otherwise(whole), _gaps(F.col(SKIP), F.col("duration_ms")), 1000)
    q = q.withColumn("rest", F.when(F.size(SKIP) > 0, rest).otherwise(F.slice(whole, 1, 0)))
    left = F.size("rest") > 0
    kinds = (("range", F.when(left, F.col("rest")).otherwise(F.col(ONLY))), ("skip", F.when(left, F.col(SKIP)).otherwise(F.slice(SKIP, 1, 0))), ("subject", F.slice(SUBJECT, 1, 1)))

    def told(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["a"].alias("a"), x["z"].alias("z")))

    rows = F.concat(*(told(*k) for k in kinds))
    return q.select("q_id", F.explode(rows).alias("r")).select("q_id", "r.kind", F.col("r.a").alias("start_ms"), F.col("r.z").alias("end_ms"))


def index_spans(scopes: DataFrame, hits: DataFrame, area: DataFrame) -> DataFrame:
    """q_id, start_ms, end_ms: where an index is built.

    scopes: q_id, scope ("all" or "found"); hits and area: q_id, start_ms, end_ms. "all" takes the area; "found" the merged
    hits (20 minutes at most) inside the area, or the area where none is inside, or all merged hits where there is no area.
    """
    found = merge_hit_spans(hits, ["q_id"]).groupBy("q_id").agg(_listed(hits, "found"))
    q = scopes.join(area.groupBy("q_id").agg(_listed(area, "area")), "q_id", "left").join(found, "q_id", "left")
    inside = _met(F.col("found"), F.col("area"))
    spans = F.when((F.col("scope") == "all") | F.col("found").isNull(), F.col("area")).when(F.col("area").isNull(), F.col("found")).when(F.size(inside) > 0, inside).otherwise(F.col("area"))
    return q.select("q_id", F.explode(spans).alias("r")).select("q_id", F.col("r.a").alias("start_ms"), F.col("r.z").alias("end_ms"))


def marked_lines(messages: DataFrame, most: int = 30) -> DataFrame:
    """conv_id, place, line, start, end (seconds): lines with a time mark of the newest answer that has any, among the last six messages."""
    lines = recent_messages(messages).where("role <> 'user'").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    mark = F.coalesce(*(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")) for pattern in (rf"@({MARK}\s*[–—-]\s*@?{MARK})", rf"\[({MARK}\s*[–—-]\s*{MARK})\]")))
    found = lines.withColumn("span", parse_range(mark)).where("span is not null and span.end is not null")
    newest = found.withColumn("_newest", F.max("turn").over(Window.partitionBy("conv_id"))).where("turn = _newest")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("n"))
    return newest.withColumn("place", place).where(F.col("place") <= most).select("conv_id", "place", clip(F.col("line"), 160).alias("line"), "span.start", "span.end")


def current_sentence(played: DataFrame) -> DataFrame:
    """played (start_ms, end_ms, text, at_ms) with `sentence`: the one spoken at at_ms.

    With timed words (array of text, start_ms) the one around the last word that has begun; without, in proportion to
    the number of sentences.
    """
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?…])\s+"), F.trim), lambda p: p != "")
    ratio = (F.col("at_ms") - F.col("start_ms")) / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))
    n = F.least(F.size(parts) - 1, F.floor(held * F.size(parts)).cast("int"))
    untimed = F.coalesce(F.get(parts, n), F.lit(""))
    if "words" not in played.columns:
        return played.withColumn("sentence", untimed)
    begun = F.size(F.filter("words", lambda w: w["start_ms"] <= F.col("at_ms") + 30))
    at = F.greatest(begun - 1, F.lit(0))
    ends = F.filter(F.transform("words", lambda w, i: F.when(sentence_closed(w["text"]), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.array_max(F.filter(ends, lambda i: i < at)) + 1, F.lit(0))
    last = F.coalesce(F.array_min(F.filter(ends, lambda i: i >= at)), F.size("words") - 1)
    timed = F.array_join(F.transform(F.slice("words", first + 1, last - first + 1), lambda w: w["text"]), " ")
    return played.withColumn("sentence", F.when(F.size("words") > 0, timed).otherwise(untimed))


def expand_quotes(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """conv_id, turn, text: tokens @[preview m:ss-m:ss] replaced by [m:ss-m:ss]{{ who: text }} of the segment of those whole seconds.

    messages: conv_id, turn, video_id, text. Of several segments the one that starts with the preview counts, else the
    first; a token without one stays.
    """
    token = r"@\[(.+?)\s+(\d+:\d{2}(?::\d{2})?)-(\d+:\d{2}(?::\d{2})?)\]"
    m = messages.withColumn("_tokens", F.regexp_extract_all("text", F.lit(token), F.lit(0)))
    said = m.select("conv_id", "turn", "video_id", F.posexplode("_tokens").alias("n", "token"))
    for k, name in enumerate(("preview", "from", "to"), 1):
        said = said.withColumn(name, F.regexp_extract("token", token, k))
    whole = lambda c: F.aggregate(F.split(c, ":"), F.lit(0).cast("long"), lambda acc, p: acc * 60 + p.cast("long"))
    said = said.withColumn("preview", F.trim(F.regexp_replace("preview", r"\.\.\.$", ""))).withColumn("a", whole("from")).withColumn("z", whole("to"))
    s = segments.select("video_id", F.floor(F.col("start_ms") / 1000).alias("a"), F.floor(F.col("end_ms") / 1000).alias("z"), "position", F.trim("text").alias("body"), F.coalesce("speaker_name", F.lit("")).alias("who"), "speaker")
    near = F.when(F.startswith(F.col("body"), F.substring("preview", 1, 24)), 0).otherwise(1)
    who = F.when((F.col("who") == "Без спикера") & F.col("speaker").isNull(), "").otherwise(F.col("who"))
    mess = F.concat(F.when(who != "", F.concat(who, F.lit(": "))).otherwise(""), "body")
    new = F.concat(F.lit("["), "from", F.lit("-"), "to", F.lit("]{{\n"), mess, F.lit("\n}}"))
    best = said.join(s, ["video_id", "a", "z"]).groupBy("conv_id", "turn", "n").agg(F.min_by(new, F.struct(near, "position")).alias("new"))
    whole_list = F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("new", "token").alias("new")))), lambda x: x["new"])
    told = said.join(best, ["conv_id", "turn", "n"], "left").groupBy("conv_id", "turn").agg(whole_list.alias("_new"))
    between = F.split("text", token)
    glued = F.array_join(F.zip_with(between, F.concat("_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return m.join(told, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.size("_tokens") > 0, glued).otherwise(F.col("text")).alias("text"))


# fixed values: the kinds of content and of message, their other forms, and phrases that say nothing
CONTENT_TYPES = ("совет", "инструкция", "разбор случая", "история", "спор", "определение", "сравнение", "личный опыт", "реклама", "отступление", "другое")
MESSAGE_TYPES = ("совет", "критика", "предупреждение", "объяснение", "вывод", "жалоба", "продажа", "вопрос", "мотивация", "другое")
OTHER = "другое"
OTHER_FORMS = {
    "советы": "совет", "критику": "критика", "предупреждения": "предупреждение", "объяснения": "объяснение", "жалобу": "жалоба", "продажу": "продажа",
    "мотивацию": "мотивация", "инструкции": "инструкция", "истории": "история", "сравнения": "сравнение", "определения": "определение",
}
VAGUE = r"(?iU)ключев\w*\s+момент|автор\s+обсужда|спикер\s+рассказывает\s+о\s+теме|в\s+этом\s+(?:отрезке|фрагменте|куск\w*|ролике)\s+(?:говорит|речь|обсужда)"
#: Of a card: column, the answer's names for it, characters at most.
FIELDS = (
    ("title", ("title", "заголовок"), 100), ("content", ("content", "содержание", "text"), 520), ("problem", ("problem", "проблема"), 180),
    ("conclusion", ("conclusion", "вывод"), 200), ("terms", ("terms", "термины"), 160), ("questions", ("questions", "вопросы"), 180),
)
#: Lines of a card as text.
HEADS = (("Тема", "title"), ("Содержание", "content"), ("Проблема", "problem"), ("Вывод", "conclusion"), ("Тип", "content_type"), ("Посыл", "message_type"), ("Термины", "terms"), ("Вопросы", "questions"))


def field(answer: Column, *names: str) -> Column:
    """The first of the names that has a value in a map of strings, without regard to case; lists as one string, objects as none."""
    given = F.filter(F.map_entries(answer), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    of = lambda n: F.get(F.filter(given, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]
    value = F.coalesce(*map(of, names), F.lit(""))
    items = F.array_join(F.filter(F.from_json(value, "array<string>"), lambda x: F.trim(x) != ""), ", ")
    return squeezed(F.when(value.startswith("{"), "").when(value.startswith("["), F.coalesce(items, value)).otherwise(value))


def closed(value: Column, options: tuple[str, ...]) -> Column:
    """The option that a value names: itself, by another form, or within a short value; else OTHER."""
    text = F.regexp_replace(F.lower(squeezed(value)), r"^[ .«»\"']+|[ .«»\"']+$", "")
    form = F.create_map(*(F.lit(x) for kv in OTHER_FORMS.items() for x in kv))[text]
    long = (F.length(text) > 40) | (F.size(F.split(text, ",")) > 2)
    within = F.coalesce(*(F.when(F.contains(text, F.lit(o)), o) for o in options), F.lit(OTHER))
    return F.when(text == "", OTHER).when(form.isNotNull(), form).when(text.isin(*options), text).when(long, OTHER).otherwise(within)


def topic_cards(answers: DataFrame) -> DataFrame:
    """key, title, content, problem, conclusion, content_type, message_type, terms, questions, text (the card as lines), vague
    (short and a stock phrase) and unfinished (long content without a closing mark) of each answer (key, answer) that
    is an object with a title or content."""
    a = answers.withColumn("_a", parse_object(F.col("answer")))
    for column, names, most in FIELDS:
        a = a.withColumn(column, clip_words(field(F.col("_a"), *names), most))
    nested = F.coalesce(F.from_json(F.get(F.filter(F.map_entries("_a"), lambda e: e["key"] == "type"), F.lit(0))["value"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    first = lambda *options: F.coalesce(*(F.when(o != "", o) for o in options), F.lit(""))
    a = a.where("_a is not null and (title <> '' or content <> '')").withColumn("_type", nested)
    a = a.withColumn("content_type", closed(first(field(F.col("_a"), "content_type"), field(F.col("_type"), "content", "содержание")), CONTENT_TYPES))
    a = a.withColumn("message_type", closed(first(field(F.col("_a"), "message_type", "посыл"), field(F.col("_type"), "посыл", "message")), MESSAGE_TYPES))
    line = lambda head, c: F.concat(F.lit(f"{head}: "), F.when((F.col(c) == "") & F.lit(c not in ("title", "content")), "нет").otherwise(F.col(c)))
    a = a.withColumn("text", F.concat_ws("\n", *(line(h, c) for h, c in HEADS)))
    vague = (F.length("text") < 240) & F.col("text").rlike(VAGUE)
    unfinished = (F.length("content") > 220) & ~F.col("content").rlike(r"[.!?…»\"']$")
    return a.select("key", *(c for _, c in HEADS), "text", vague.alias("vague"), unfinished.alias("unfinished"))


def parse_objects(answers: DataFrame) -> DataFrame:
    """key, object_no, object (JSON): every whole object, outermost only, in an answer (key, answer), also amid prose."""

    def run(batches):
        decoder = json.JSONDecoder()
        for b in batches:
            rows = []
            for key, text in zip(b["key"], b["answer"], strict=True):
                at, no = (text or "").find("{"), 0
                while at >= 0:
                    try:
                        found, to = decoder.raw_decode(text, at)
                        rows.append((key, no, json.dumps(found, ensure_ascii=False, separators=(",", ":"))))
                        at, no = text.find("{", to), no + 1
                    except ValueError:
                        at = text.find("{", at + 1)
            yield pd.DataFrame(rows, columns=["key", "object_no", "object"])

    return answers.select("key", "answer").mapInPandas(run, f"key {answers.schema['key'].dataType.simpleString()}, object_no int, object string")


def topics_brief(topics: DataFrame, most: int = 12_000) -> DataFrame:
    """video_id, text: "n. title. Проблема: … Вывод: … Посыл: …" of a video's cards (topic_no), cut to ``most`` characters.

    Lines beyond the cut are left out before they are gathered; one that starts right after it stays, as the line end before it is
    the last character.
    """
    said = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" {head}: "), c, F.lit("."))).otherwise("")
    line = F.concat((F.col("topic_no") + 1).cast("string"), F.lit(". "), "title", F.lit("."), said("Проблема", F.col("problem")), said("Вывод", F.col("conclusion")), said("Посыл", F.col("message_type")))
    before = Window.partitionBy("video_id").orderBy("topic_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = topics.select("video_id", "topic_no", line.alias("_l")).withColumn("_used", F.coalesce(F.sum(F.length("_l") + 1).over(before), F.lit(0))).where(F.col("_used") <= most)
    return rows.groupBy("video_id").agg(F.substring(_lines(["topic_no"], F.col("_l")), 1, most).alias("text"))
