"""Corrections that a model proposes for single words: reading its answer, and applying what is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of an answer's lines that are headings, and answers that mean "nothing".
HEADINGS = ("правки", "пример", "слова", "ответ")
NOTHING = ("нет", "нет.", "no", "none")


def _bare(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, r"^`+|`+$", ""), r"^(['\"])(.*)\1$", "$2")


def parse_fixes(answers: DataFrame) -> DataFrame:
    """key, line_no, word_no, old, new: the lines "N old -> new" and "N old new" of each answer (key, answer)."""
    lines = answers.select("key", F.posexplode(F.split("answer", "\r?\n")).alias("line_no", "raw"))
    line = F.regexp_replace(F.trim("raw"), r"^`+|`+$", "")
    low = F.lower("line")
    heading = low.rlike(f"^({'|'.join(HEADINGS)})")
    body = lines.withColumn("line", line).where((F.col("line") != "") & ~low.isin(*NOTHING) & ~heading)
    # a fixed value: the form of a line
    whole = r"^\s*(\d+)\s*[:.)]?\s+(\S+)(?:\s*(?:->|=>|—|–)\s*|\s+)(\S+)\s*$"
    at = lambda k: F.regexp_extract("line", whole, k)
    read = body.where(F.col("line").rlike(whole)).select("key", "line_no", at(1).cast("int").alias("word_no"), _bare(at(2)).alias("old"), _bare(at(3)).alias("new"))
    return read.where("old <> '' and new <> '' and word_no is not null")


def _patch(text: str | None, words: list[str] | None, places: list[int], olds: list[str], news: list[str]) -> tuple[str | None, list[str] | None]:
    if text is None or words is None or not len(places):
        return text, words
    # where the walk is after so many words, -1 once it has lost its way; a fix leaves what is before its word as it was
    words, walked = list(words), [0]
    for k, old, new in zip(places, olds, news, strict=True):
        if k is None or not 0 <= k < len(words) or not old or new is None or words[k] != old:
            continue
        while len(walked) <= k and walked[-1] >= 0:
            w = words[len(walked) - 1]
            at = text.find(w, walked[-1]) if w else -1
            walked.append(at + len(w) if at >= 0 else -1)
        at = text.find(old, walked[k]) if len(walked) > k and walked[k] >= 0 else -1
        if at >= 0:
            text, words[k] = text[:at] + new + text[at + len(old) :], new
            del walked[k + 1 :]
    return text, words


def _patched(text: Column, words: Column, fixes: Column) -> Column:
    """struct(text, words) after the fixes (array of line_no, word_no, old, new; null: none), one after the other: each word of a text is
    looked for from the end of the one before, so the work grows with the text."""
    patch = F.udf(_patch, "text string, words array<string>", useArrow=True)
    return patch(text, words, F.coalesce(fixes["word_no"], F.array().cast("array<int>")), F.coalesce(fixes["old"], F.array().cast("array<string>")), F.coalesce(fixes["new"], F.array().cast("array<string>")))


def _apply(segments: DataFrame, fixes: DataFrame, allowed) -> DataFrame:
    f = F.struct("line_no", "word_no", "old", "new")
    listed = fixes.groupBy(F.col("key").alias("id")).agg(F.array_sort(F.collect_list(f)).alias("_fixes"))
    # what isn't allowed goes from the lists: a filter of the rows would parse each line again
    listed = listed.withColumn("_fixes", F.filter("_fixes", lambda x: (x["old"] != x["new"]) & allowed(x["old"], x["new"])))
    told = segments.join(listed, "id", "left")
    done = _patched(F.col("text"), F.col("words"), F.col("_fixes"))
    return told.withColumn("_done", done).withColumn("text", F.col("_done.text")).withColumn("words", F.col("_done.words")).drop("_done", "_fixes")


def apply_case_fixes(segments: DataFrame, fixes: DataFrame) -> DataFrame:
    """segments (id, text, words: array of tokens) with the fixes that change a word's case only, in order of their lines.

    A fix counts if its place exists, holds `old`, and the walk over the words before finds it in the text.
    """
    return _apply(segments, fixes, lambda old, new: F.lower(old) == F.lower(new))


def apply_anglicisms(segments: DataFrame, fixes: DataFrame) -> DataFrame:
    """The same for fixes that write a Cyrillic word in Latin letters."""
    return _apply(segments, fixes, lambda old, new: old.rlike(r"[А-Яа-яЁё]") & new.rlike(r"[A-Za-z]") & ~new.rlike(r"[А-Яа-яЁё]"))


# fixed values: grades by the consonants of their names, words that show the talk is of grades, words that are none, case endings
GRADES = {"mdl": "Middle", "snr": "Senior", "jnr": "Junior", "jn": "Junior"}
GRADE_TALK = ("грейд", "уровн", "компан", "ваканс", "позиц", "должност", "стаж")
NO_GRADES = ("model", "medal", "module", "modern", "modest", "sinner", "dinner", "minor", "manor", "singer", "june", "jean")
CASE_ENDINGS = ("ами", "ов", "ом", "ах", "ам", "ой", "а", "у", "е", "ы")
#: Russian consonants and the Latin letters that they count as.
CONSONANTS = ("бвгджзйклмнпрстфхцчшщ", "bvgdzzjklmnprstfhccss")


def skeleton(word: Column) -> Column:
    """The consonants of a word in lower case, as Latin letters, repeats as one."""
    latin = F.translate(F.regexp_replace(word, "дж", "j"), *CONSONANTS)
    return F.regexp_replace(F.regexp_replace(latin, "[^a-z]|[aeiouy]", ""), r"(.)\1+", "$1")


def grade_of(word: Column) -> Column:
    """Middle, Senior or Junior, if the word (letters, lower case) is one of them in another spelling; else null."""
    stem = F.regexp_replace(word, f"^(.{{4,}}?)(?:{'|'.join(CASE_ENDINGS)})$", "$1")
    title = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))[skeleton(stem)]
    return F.when((word != "") & ~word.isin(*NO_GRADES) & (F.lower(title) != word), title)


def normalize_terms(segments: DataFrame) -> DataFrame:
    """segments (text, words: array of tokens, or null for those of the text) with grades in their usual spelling.

    Only where the talk is of grades: a word says so, or two words or more are grades. Parts between dashes count by
    themselves, marks around a word stay. Nothing is shuffled.
    """
    letters = lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\p{L}]", ""))
    part = lambda w, k: F.regexp_extract(w, r"(?U)^(\W*)(.+?)(\W*)$", k)
    graded = lambda w: F.concat(part(w, 1), F.array_join(F.transform(F.split(part(w, 2), "-"), lambda x: F.coalesce(grade_of(letters(x)), x)), "-"), part(w, 3))
    own = F.filter(F.split(F.col("text"), r"\s+"), lambda x: x != "")
    told = segments.withColumn("_w", F.when(F.size("words") > 0, F.col("words")).otherwise(own))
    cue = F.lower(F.coalesce("text", F.lit(""))).rlike("|".join(GRADE_TALK))
    talk = cue | (F.size(F.filter("_w", lambda w: grade_of(letters(w)).isNotNull())) >= 2)
    fix = lambda w, i: F.struct(i.alias("line_no"), i.alias("word_no"), w.alias("old"), graded(w).alias("new"))
    fixes = F.filter(F.transform("_w", fix), lambda x: (x["new"] != "") & (x["new"] != x["old"]))
    told = told.withColumn("_f", fixes).withColumn("_done", _patched(F.col("text"), F.col("_w"), F.when(talk, F.col("_f"))))
    words = F.when(F.size("words") > 0, F.coalesce("_done.words", "words")).otherwise(F.col("words"))
    return told.withColumn("words", words).withColumn("text", F.coalesce("_done.text", "text")).drop("_w", "_f", "_done")
