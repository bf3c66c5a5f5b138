"""Phrases that a cut between turns has broken: who owns them, and turns joined by the verdicts.

A verdict never changes what is said, only where one turn ends and the next begins: a border between two turns stays, goes,
or moves behind the right one's opening sentence or before the left one's open remainder. So each turn is brought down to a
few numbers (Spark functions), a fold over these places the borders, and turns are put together from what lies between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import array_fold, let
from .repair import words_of

# fixed values: where a sentence ends, the tokens by which texts and timed words are aligned, and words of the first person
SENTENCE_END = r"[.!?…]+(?:\s+|$)"
TOKEN = r"[0-9A-Za-zА-Яа-яЁё-]+"
FIRST_PERSON = r"(?iU)\b(?:я|мне|меня|мой|моя|моё|мои)\b"
#: A remainder of more words than this is its speaker's own.
SHORT = 3
WORDS = "array<struct<text:string,start_ms:bigint,end_ms:bigint>>"


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def opening(text: Column) -> Column:
    """The first sentence with the white space after it; all of a text without a sentence's end."""
    return F.regexp_extract(text, rf"(?s)^(.*?(?:{SENTENCE_END}|\z))", 1)


def finished(text: Column) -> Column:
    """What lies before the open remainder: up to the last sentence's end; nothing without one."""
    return F.regexp_extract(text, rf"(?s)^(.*{SENTENCE_END})", 1)


def traits(text: Column, head: Column, closed: Column) -> Column:
    """Of a trimmed text, its opening and its finished part: their ends in characters, and what the owner of a phrase depends on."""
    rest = F.substr(text, F.length(closed) + 1)
    return F.struct(
        F.length(head).alias("opening"), F.length(closed).alias("finished"), F.length(text).alias("all"),
        head.rlike(FIRST_PERSON).alias("claims"), F.size(words_of(rest)).alias("open_words"), rest.rlike(FIRST_PERSON).alias("open_own"),
    )


def goes_right(closed: Column, open_words: Column, own: Column, claims: Column) -> Column:
    """Does the broken phrase belong to the right speaker: a short remainder after a finished sentence, not in the first person, that goes
    on in the first person."""
    return closed & open_words.between(1, SHORT) & ~own & claims


def cut_owner(left: Column, right: Column) -> Column:
    """"left" or "right": who owns a phrase that a cut between two speakers has broken."""
    a, b = (traits(t, opening(t), finished(t)) for t in (stripped(left), stripped(right)))
    return F.when(F.coalesce(goes_right(a["finished"] > 0, a["open_words"], a["open_own"], b["claims"]), F.lit(False)), "right").otherwise("left")


def covered(words: Column, text: Column) -> Column:
    """How many of the words have, one after the other, just the tokens of the text; 0 if none."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))
    need, have = tokens(text), F.transform(words, lambda w: tokens(F.coalesce(w["text"], F.lit(""))))
    # the fewest words with as many tokens as are needed
    seen = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("n"))
    count = F.aggregate(have, seen, lambda a, t: F.when(a["tokens"] >= F.size(need), a).otherwise(F.struct((a["tokens"] + F.size(t)).alias("tokens"), (a["n"] + 1).alias("n"))))["n"]
    return F.coalesce(F.when((F.size(need) > 0) & (F.flatten(F.slice(have, F.lit(1), count)) == need), count), F.lit(0))


_OPEN = "struct<speaker: string, closed: boolean, words: bigint, own: boolean, since: bigint>"
_BORDER = "struct<border: string, since: bigint, taken: boolean>"


def _place(s: Column, r: Column) -> Column:
    """The border before row r, and the open turn after it: its speaker, has it a finished sentence, how many words of its remainder, are
    they in the first person, and the row in which its last sentence ended."""
    t = r["t"]
    ends, empty = t["finished"] > 0, t["all"] == 0
    same = s["speaker"].isNotNull() & (s["speaker"] != "") & s["speaker"].eqNullSafe(r["speaker"])
    right = F.coalesce(goes_right(s["closed"], s["words"], s["own"], t["claims"]), F.lit(False))
    border = (
        F.when(s.isNull() | ~r["is_cut"], "here").when(same, "none").when(right, "remainder").when(empty, "here").when(t["opening"] == t["all"], "none").otherwise("opening")
    )

    def placed(border: Column) -> Column:
        # what goes on with the row: all of the open turn, its remainder, or nothing
        goes_on = border.isin("none", "remainder") & ~ends
        carried = F.when(goes_on, s["words"]).otherwise(0) + t["open_words"]
        own = F.when(goes_on, s["own"]).otherwise(False) | t["open_own"]
        closed = F.when(border == "none", s["closed"] | ends).when(border == "opening", t["finished"] > t["opening"]).otherwise(ends)
        since = F.when(~ends & (border == "none"), s["since"]).otherwise(r["place"])
        speaker = F.when(border == "none", s["speaker"]).otherwise(r["speaker"])
        state = F.struct(speaker.alias("speaker"), closed.alias("closed"), carried.cast("long").alias("words"), own.alias("own"), since.alias("since"))
        out = F.struct(border.alias("border"), F.when(border == "remainder", s["since"]).alias("since"), ((border == "none") & ~same).alias("taken"))
        return F.struct((border != "none").alias("begins"), out.alias("out"), state.cast(_OPEN).alias("s"))

    return let(border, placed)


def stitch_segments(segments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """video_id, position, speaker, text, start_ms, end_ms, words of the turns after ``verdicts`` (video_id, position,
    is_cut: is the phrase broken between this turn and the one before).

    Turns of one speaker are joined; between speakers the broken phrase goes to its owner, with its timed words where
    they align (those of a remainder from the last one back), else these stay where they are. A turn joined to others has the first one's
    position, and its time is that of its words where it has been cut and has any.
    """
    s = segments if "words" in segments.columns else segments.withColumn("words", F.lit(None).cast(WORDS))
    s = s.withColumns({"text": stripped(F.coalesce("text", F.lit(""))), "words": F.coalesce(F.col("words").cast(WORDS), F.array().cast(WORDS))})
    told = s.join(verdicts.select("video_id", "position", "is_cut"), ["video_id", "position"], "left").withColumns({"_head": opening(F.col("text")), "_closed": finished(F.col("text")), "is_cut": F.coalesce("is_cut", F.lit(False))})
    told = told.select("video_id", "position", "speaker", "text", "start_ms", "end_ms", "words", "is_cut", traits(F.col("text"), F.col("_head"), F.col("_closed")).alias("t"))
    placed = array_fold(told, ["video_id"], "position", _OPEN, _place, _BORDER).select("video_id", "position", "speaker", "text", "start_ms", "end_ms", "words", "t", "no", "out.*")
    # rows from the one whose remainder has moved up to the border belong, from there on, to the turn after it
    moved = placed.where("border = 'remainder'").select("video_id", F.explode(F.sequence("since", F.col("position") - 1)).alias("position"), F.col("since").alias("_from"), F.col("no").alias("_next"))
    rows = placed.join(moved, ["video_id", "position"], "left")

    own, size, t = F.col("no"), F.length("text"), F.col("t")
    head, tail = t["opening"], t["finished"]
    part = lambda no, a, z, words, end, lead: F.struct(no.alias("no"), stripped(F.substr("text", a + 1, z - a)).alias("text"), words.cast(WORDS).alias("words"), end.alias("end_ms"), lead.alias("lead"))
    # how many words go to the turn before: those of the opening, or of a row that another speaker's turn takes as a whole
    given = F.when(F.col("border") == "opening", F.substr("text", F.lit(1), head)).when(F.col("taken"), F.col("text"))
    rows = rows.withColumn("_given", given).withColumn("_n", F.when(F.col("_given").isNotNull() & (F.size("words") > 0), covered(F.col("words"), F.col("_given"))).otherwise(0))
    rows = rows.withColumn("_front", F.slice("words", F.lit(1), F.col("_n")))
    rows = rows.withColumn("_mine", F.when(F.col("taken"), F.col("_front")).otherwise(F.slice("words", F.col("_n") + 1, F.greatest(F.size("words") - F.col("_n"), F.lit(0)))))
    mine, front = F.col("_mine"), F.col("_front")
    zero, none = F.lit(0), F.array().cast(WORDS)
    begins = F.when(F.col("border") == "opening", head).otherwise(zero)
    leaves = F.when(F.col("_next").isNull(), size).when(F.col("position") == F.col("_from"), tail).otherwise(zero)
    until = F.when(F.col("taken") & (F.size(mine) > 0), F.element_at(mine, -1)["end_ms"]).otherwise(F.col("end_ms"))
    parts = F.array(
        F.when(F.col("border") == "opening", part(own - 1, zero, head, front, F.when(F.size(front) > 0, F.element_at(front, -1)["end_ms"]).otherwise(F.col("end_ms")), F.lit(False))),
        part(own, begins, leaves, mine, until, F.lit(False)),
        F.when(F.col("_next").isNotNull(), part(F.col("_next"), leaves, size, none, F.lit(None).cast("long"), F.lit(True))),
    )
    began = F.when((F.col("border") == "opening") & (F.size(mine) > 0), F.struct(F.element_at(mine, 1)["start_ms"].alias("start_ms"), F.element_at(mine, -1)["end_ms"].alias("end_ms"))).otherwise(F.struct("start_ms", "end_ms"))
    each = rows.select("video_id", "position", F.when(F.col("border") != "none", F.struct("no", "position", "speaker", began.alias("time"), "border")).alias("first"), F.posexplode(F.filter(parts, lambda p: p.isNotNull())).alias("k", "p"))
    each = each.select("video_id", "position", "k", "p.*", F.when(F.col("first.no") == F.col("p.no"), F.when(~F.col("p.lead"), F.col("first"))).alias("first"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", "k", c.alias("x")))), lambda r: r["x"])
    joined = lambda c: F.array_join(F.filter(c, lambda x: x != ""), " ")
    turns = each.groupBy("video_id", "no").agg(
        F.max("first").alias("first"), joined(in_order(F.col("text"))).alias("text"), joined(in_order(F.when(F.col("lead"), F.col("text")).otherwise(""))).alias("lead"),
        F.flatten(in_order(F.col("words"))).alias("words"), F.max(F.when(F.col("first").isNull(), F.col("end_ms"))).alias("until"),
    )
    return _with_moved_words(turns)


def _with_moved_words(turns: DataFrame) -> DataFrame:
    """Turns whose remainder has gone to the next one give it the words that align."""
    w = Window.partitionBy("video_id").orderBy("no")
    after = F.when(F.lead("first.border").over(w) == "remainder", F.lead("lead").over(w))
    t = turns.withColumn("_gives", after).withColumn("_n", F.when(F.col("_gives").isNotNull() & (F.size("words") > 0), covered(F.reverse("words"), F.col("_gives"))).otherwise(0))
    t = t.withColumn("_kept", F.slice("words", F.lit(1), F.size("words") - F.col("_n"))).withColumn("_moved", F.slice("words", F.size("words") - F.col("_n") + 1, F.col("_n")))
    t = t.withColumn("_got", F.coalesce(F.when(F.col("first.border") == "remainder", F.lag("_moved").over(w)), F.array().cast(WORDS)))
    words, end = F.concat("_got", "_kept"), F.greatest(F.col("first.time.end_ms"), F.col("until"))
    by_words = F.col("_gives").isNotNull() & (F.size(words) > 0)
    start = F.when(by_words, F.element_at(words, 1)["start_ms"]).when(F.size("_got") > 0, F.element_at("_got", 1)["start_ms"]).otherwise(F.col("first.time.start_ms"))
    stop = F.when(by_words, F.element_at(words, -1)["end_ms"]).otherwise(end)
    return t.select("video_id", F.col("first.position").alias("position"), F.col("first.speaker").alias("speaker"), "text", start.alias("start_ms"), stop.alias("end_ms"), words.alias("words"))
