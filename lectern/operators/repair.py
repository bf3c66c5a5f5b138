"""Text repair on segments: cleaning, neighbours, splitting, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ends_sentence, sentence_closed


def in_order():
    return Window.partitionBy("video_id").orderBy("position")


def words_of(text: Column) -> Column:
    """Words at white space; none for an empty text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def restarted_thought(left: Column, right: Column) -> Column:
    """The last word left and the first word right, letters only, differ but share their first six or more."""
    letters = lambda c: F.lower(F.regexp_replace(c, r"(?U)[^\p{L}]", ""))
    a, b = letters(F.try_element_at(words_of(left), F.lit(-1))), letters(F.try_element_at(words_of(right), F.lit(1)))
    return F.coalesce((F.length(a) >= 6) & (F.length(b) >= 6) & (a != b) & (F.substring(a, 1, 6) == F.substring(b, 1, 6)), F.lit(False))


def junctions(segments: DataFrame, most: int = 16) -> DataFrame:
    """Neighbours: the last words of the left, the first of the right, and what rules say: closed, restarted or open."""
    nxt = F.lead("text").over(in_order())
    s = segments.select("video_id", "position", "text", nxt.alias("next")).where("next is not null")
    w, n = words_of(F.col("text")), words_of(F.col("next"))
    verdict = F.when(sentence_closed(F.col("text")), "closed").when(restarted_thought(F.col("text"), F.col("next")), "restarted").otherwise("open")
    left = F.when(F.size(w) > most, F.slice(w, -most, most)).otherwise(w)
    return s.select("video_id", "position", F.array_join(left, " ").alias("left_words"), F.array_join(F.slice(n, 1, most), " ").alias("right_words"), verdict.alias("verdict"))


def clean_asr(segments: DataFrame) -> DataFrame:
    """Trimmed texts, empty ones dropped, words (array of text, start_ms, end_ms) without empty ones, no speaker.

    Times are whole milliseconds, so there is nothing to round.
    """
    s = segments.withColumn("text", F.trim("text")).where("text <> ''").withColumn("speaker", F.lit(None).cast("string"))
    if "words" not in segments.columns:
        return s
    trimmed = F.transform("words", lambda w: F.struct(F.trim(w["text"]).alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms")))
    return s.withColumn("words", F.filter(trimmed, lambda w: w["text"] != ""))


def clean_words(words: Column) -> Column:
    """The words (structs of text, start, end as strings) with a text and numeric times."""
    return F.filter(words, lambda w: (F.trim(w["text"]) != "") & w["start"].try_cast("double").isNotNull() & w["end"].try_cast("double").isNotNull())


def shift_times(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Times within a chunk as times of the video, also those of the words (structs with start_ms and end_ms), if there are any."""
    c = chunks.select("video_id", "chunk_no", F.col("start_ms").alias("_at"))
    at = lambda t: t + F.col("_at")
    s = segments.join(c, ["video_id", "chunk_no"]).withColumn("start_ms", at(F.col("start_ms"))).withColumn("end_ms", at(F.col("end_ms")))
    if "words" in segments.columns:
        s = s.withColumn("words", F.transform("words", lambda w: w.withField("start_ms", at(w["start_ms"])).withField("end_ms", at(w["end_ms"]))))
    return s.drop("_at")


def case_candidates(segments: DataFrame) -> DataFrame:
    """Words with a capital inside a sentence, with six words before and four after."""
    s = segments.select("video_id", "position", words_of(F.col("text")).alias("w"))
    at = F.explode(F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("word"))), lambda x: (x["i"] > 0) & x["word"].rlike(r"(?U)\p{Lu}")))
    rows = s.select("*", at.alias("c")).where(~sentence_closed(F.element_at("w", F.col("c.i"))))
    i = F.col("c.i")
    first = F.greatest(i - 6, F.lit(0))
    return rows.select("video_id", "position", i.cast("long").alias("word_no"), F.col("c.word").alias("word"), F.array_join(F.slice("w", first + 1, i - first + 5), " ").alias("fragment"))


def split_segments(segments: DataFrame, n: int = 4) -> DataFrame:
    """Turns of more than n sentences as pieces of n: video_id, position, piece_no, text, start_ms, end_ms, words.

    ``words`` (array of text, start_ms, end_ms) may be null, or its first word without times: then pieces share the
    turn's time in proportion to the lengths of their texts, the last ends where the turn does, and they have no words.
    Turns of n sentences or fewer stay as they are. All is within one row, so nothing is shuffled.
    """
    untimed = F.transform(words_of(F.col("text")), lambda x: F.struct(x.alias("text"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms")))
    given = F.filter("words", lambda w: F.trim(w["text"]) != "") if "words" in segments.columns else F.lit(None).cast("array<struct<text string, start_ms bigint, end_ms bigint>>")
    s = segments.select("video_id", "position", "start_ms", "end_ms", "text", given.alias("_own")).withColumn("_w", F.when(F.size("_own") > 0, F.col("_own")).otherwise(untimed))
    # most words have no mark of an end, and need no closer look
    ends = F.filter(F.transform("_w", lambda w, i: F.when(w["text"].rlike("[.!?…]"), F.when(ends_sentence(w["text"]), i))), lambda i: i.isNotNull())
    s = s.withColumn("_ends", ends).withColumn("_last", F.size("_w") - 1)
    sentences = F.size("_ends") + F.when(F.coalesce(F.try_element_at("_ends", F.lit(-1)), F.lit(-1)) < F.col("_last"), 1).otherwise(0)
    s = s.withColumn("_n", F.ceil(sentences / n).cast("int")).withColumn("_split", sentences > n)
    first = lambda k: F.when(k == 0, 0).otherwise(F.get("_ends", k * n - 1) + 1)
    to = lambda k: F.coalesce(F.get("_ends", k * n + n - 1), F.col("_last"))
    parts = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.slice("_w", first(k) + 1, to(k) - first(k) + 1))
    text = lambda p: F.array_join(F.transform(p, lambda w: F.trim(w["text"])), " ")
    s = s.withColumn("_parts", F.when(F.col("_split"), parts)).withColumn("_texts", F.transform("_parts", text))
    # characters before each piece, and of all
    upto = F.aggregate("_texts", F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t))))
    s = s.withColumn("_upto", upto)
    before = lambda k: F.get("_upto", k)
    all_chars, span = F.greatest(F.element_at("_upto", -1), F.lit(1)), F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    shared = lambda k: F.col("start_ms") + F.floor(span * before(k) / all_chars)
    timed, none = F.try_element_at("_w", F.lit(1))["start_ms"].isNotNull(), F.filter("_w", lambda w: F.lit(False))

    def piece(p: Column, k: Column) -> Column:
        start = F.when(timed, F.element_at(p, 1)["start_ms"]).otherwise(shared(k))
        end = F.when(timed, F.element_at(p, -1)["end_ms"]).when(k == F.col("_n") - 1, F.col("end_ms")).otherwise(shared(k + 1))
        return F.struct(F.get("_texts", k).alias("text"), start.alias("start_ms"), end.alias("end_ms"), F.when(timed, p).otherwise(none).alias("words"))

    whole = F.array(F.struct("text", "start_ms", "end_ms", F.coalesce("_own", none).alias("words")))
    pieces = F.when(F.col("_split"), F.transform("_parts", piece)).otherwise(whole)
    return s.select("video_id", "position", F.posexplode(pieces).alias("piece_no", "_p")).select("video_id", "position", F.col("piece_no").cast("long").alias("piece_no"), "_p.*")


def prepare_store(segments: DataFrame) -> DataFrame:
    """Trimmed, without empty texts, numbered from 0, with the text to embed."""
    s = segments.withColumn("text", F.trim("text")).where("text <> ''")
    embed = F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "), "text")).otherwise(F.col("text"))
    return s.withColumn("position", F.row_number().over(in_order()).cast("long") - 1).withColumn("embed_text", embed)


# fixed values: words that a capital doesn't suit inside a sentence, and endings of verbs
NUMBERS = tuple("ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто сто".split())
FUNCTION_WORDS = tuple("в во на с со к ко о об обо и а но или да не ни же бы ли это эта этот эти то для по из за от до без при через что как если когда".split())
INDEFINITE = tuple("какой-то какое-то какая-то какие-то чей-то чья-то чьё-то чьи-то кто-то что-то где-то когда-то куда-то почему-то зачем-то как-то".split())
VERB_ENDINGS = tuple("иться аться яться еться ются аются уются или али ели ули ыли ить ать ять еть уть ыть оть ется ится ешь ишь ет ит ут ют ат ят".split())


def letters_of(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"(?U)[^\p{L}]", ""))


def chunk_capital(previous: Column, token: Column) -> Column:
    """Has only a chunk's border given the word its capital? Names and brands aren't such words.

    It repeats the word before, is a numeral after digits, an indefinite or a function word, or a Russian word of five
    letters or more with a verb's ending.
    """
    bare = F.regexp_replace(F.lower(token), r"^[.,;:!?]+|[.,;:!?]+$", "")
    now = letters_of(token)
    repeated = (now != "") & (now == letters_of(previous))
    verb = (F.length(now) >= 5) & (now == bare) & now.rlike("[а-яё]") & now.rlike(f"(?:{'|'.join(VERB_ENDINGS)})$")
    return repeated | (previous.rlike(r"(?U)\d") & now.isin(*NUMBERS)) | bare.isin(*INDEFINITE) | now.isin(*FUNCTION_WORDS) | verb
