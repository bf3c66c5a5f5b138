"""Names of speakers: what they call themselves and each other, proposals checked against the words, nicknames for the rest.

One pass over the segments turns them into a few findings: names that speakers give themselves, and for each proposed name who says its
parts, as whose. Findings become claims of a label to a name, in an order of strength, and a video's claims, a handful, are settled by one
rule for all of them. Texts are never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

# fixed values: nicknames
NICKNAMES = tuple(
    "Пёс Лис Кот Волк Медведь Заяц Ёж Сова Ворон Барсук Рысь Олень Белка Хомяк Выдра Журавль Крот Лось Енот Пингвин Тигр Леопард "
    "Гепард Норка Куница Соболь Песец Шакал Сурок Бобр Нерпа Тюлень Кабан Косуля Ласка Горностай Филин Дятел Сорока Цапля".split()
)
# fixed values: how a name is said, by its owner, of a partner, and in addressing someone
_NAME_WORDS = r"([A-Za-zА-Яа-яЁё-]+(?:\s+[A-Za-zА-Яа-яЁё-]+){0,2})"
SELF = (r"меня\s+зовут\s+" + _NAME_WORDS, r"это\s+был[аио]?\s+" + _NAME_WORDS)
PARTNER = r"(?:мы\s+с|вместе\s+с)\s+" + _NAME_WORDS
ADDRESS = r"(?:^|[.!?]\s+)([A-Za-zА-Яа-яЁё-]+)\s*[,:]"
# fixed values: what makes a name no name
VOWELS = "аеёиоуыэюяaeiouy"
NONSENSE = r"ые|еы|уые|й(?=[^аеёиоуыэюя])|[ъь]"

_WORD = re.compile(r"[A-Za-zА-Яа-яЁё-]+")
_BORDER = re.compile(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])")
_SHAPE = re.compile(r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё-]{0,60}")
_NONSENSE = re.compile(NONSENSE, re.IGNORECASE)
_FOUR_CONSONANTS = re.compile(f"[^{VOWELS}]{{4}}")
_SELF = tuple(re.compile(p, re.IGNORECASE) for p in SELF)
_OF_OTHERS = (re.compile(PARTNER, re.IGNORECASE), re.compile(ADDRESS, re.MULTILINE))


def parts_of(name: str) -> list[str]:
    """The words of a name, also of one written as one word with capitals."""
    return _WORD.findall(_BORDER.sub(" ", name))


def cleaned(raw: str | None) -> str | None:
    """The name as one word, if it has the shape and sound of one."""
    name = "".join((raw or "").split())
    parts = [p.casefold() for p in parts_of(name)]
    sounds = all(2 <= len(p) <= 20 and p[0] not in "ыъь" and any(c in VOWELS for c in p) and not _NONSENSE.search(p) and not _FOUR_CONSONANTS.search(p) for p in parts)
    return name if _SHAPE.fullmatch(name) and parts and sounds else None


@lru_cache(100_000)
def in_cases(part: str) -> re.Pattern | None:
    """What finds the part of a name in some case as a word: it with up to three letters more, or (of four letters or more) with its last
    one replaced by one or two."""
    letter = "[A-Za-zА-Яа-яЁё-]"
    if len(part) < 2:
        return None
    forms = [f"{re.escape(part)}{letter}{{0,3}}"] + ([f"{re.escape(part[:-1])}{letter}{{1,2}}"] if len(part) >= 4 else [])
    return re.compile(f"(?<!{letter})(?:{'|'.join(forms)})(?!{letter})", re.IGNORECASE)


def parts_said(parts: list[str], text: str) -> list[bool]:
    """Of each part of a name: does the text have it?"""
    return [bool((p := in_cases(x.casefold())) and p.search(text)) for x in parts]


def said(name: str, text: str) -> bool:
    parts = parts_of(name)
    return bool(parts) and all(parts_said(parts, text))


def mentioned(name: Column, text: Column) -> Column:
    """Do all parts of the name stand in the text, in whatever case?"""

    @F.pandas_udf("boolean")
    def run(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if n is None or t is None else said(n, t) for n, t in zip(names, texts, strict=True)], dtype="object")

    return run(name, text)


#: Words that a phrase with a name has at most: it may go on in the speaker's next turns.
PHRASE_WORDS = 5


def _told(segments: DataFrame) -> DataFrame:
    """video_id, speaker, position, text and more: the text with the words that the speaker goes on with, as many as a phrase may need."""
    w = Window.partitionBy("video_id", "speaker").orderBy("position")
    spoken = segments.where(F.col("speaker").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    head = F.array_join(F.slice(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != ""), 1, PHRASE_WORDS), " ")
    spoken = spoken.select("video_id", "speaker", "position", "text", head.alias("_head"))
    return spoken.withColumn("more", F.concat_ws("\n", "text", *(F.lead("_head", k).over(w) for k in range(1, PHRASE_WORDS + 1)))).drop("_head")


def _phrases(patterns: tuple[re.Pattern, ...], text: str, more: str) -> list[tuple[int, str]]:
    """(place, words after the phrase) where a pattern begins within the text."""
    return [(m.start(), m[1]) for p in patterns for m in p.finditer(more) if m.start() <= len(text)]


def spoken_name(segments: DataFrame) -> DataFrame:
    """video_id, speaker, name: the last plausible name that a speaker calls themselves by, of those who do."""
    found = findings(segments).where("kind = 'own'")
    return found.groupBy("video_id", "speaker").agg(F.max_by("name", F.struct("position", "at")).alias("name"))


def findings(segments: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """What a segment says of names: video_id, speaker, position, at, kind, label, name, parts, part.

    kind "own": the speaker's name (no label); of a proposal (label, name): "intro", the speaker gives it as theirs; "partner", as
    that of someone beside them or addressed; "part", the speaker says the part of this number.
    """
    t = segments.schema
    video, position = (t[c].dataType.simpleString() for c in ("video_id", "position"))
    rows = _told(segments)
    if proposals is not None:  # one for each label at most
        rows = rows.join(proposals.groupBy("video_id").agg(F.collect_list(F.struct("label", "name")).alias("proposed")), "video_id", "left")
    else:
        rows = rows.withColumn("proposed", F.lit(None))
    columns = ["video_id", "speaker", "position", "at", "kind", "label", "name", "parts", "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for video, speaker, position, text, more, proposed in b[["video_id", "speaker", "position", "text", "more", "proposed"]].itertuples(index=False):
                own, others = _phrases(_SELF, text, more), _phrases(_OF_OTHERS, text, more)
                plausible = [(at, name) for at, phrase in own if (name := cleaned(phrase))]
                if plausible:
                    at, name = max(plausible)
                    out.append((video, speaker, position, at, "own", None, name, _people(name), None))
                for x in [] if proposed is None else proposed:
                    name = cleaned(x["name"])
                    if name is None:
                        continue
                    kinds = [("intro", 0)] * any(said(name, p) for _, p in own) + [("partner", 0)] * any(said(name, p) for _, p in others)
                    kinds += [("part", k) for k, yes in enumerate(parts_said(parts_of(name), text)) if yes]
                    out += [(video, speaker, position, 0, kind, x["label"], name, _people(name), k) for kind, k in kinds]
            yield pd.DataFrame(out, columns=columns).astype({"part": "Int64"})

    return rows.mapInPandas(run, f"video_id {video}, speaker string, position {position}, at int, kind string, label string, name string, parts array<string>, part int")


def _people(name: str) -> list[str]:
    return [p.casefold() for p in parts_of(name)]


_CLAIM = "struct<strength: int, by_no: int, of_no: int, label: string, name: string, parts: array<string>, by: string>"
_HELD = "array<struct<label: string, name: string, parts: array<string>, strength: int, own: boolean>>"
#: Strength of a claim: the speaker's own word, their word on a proposal, that of the other of two, a proposal that nothing speaks against.
OWN, INTRO, PARTNER, FREE = range(4)


def claims(found: DataFrame, labels: DataFrame) -> DataFrame:
    """video_id, labels and claims (an array in order of strength, who makes it, and the proposal's label), from findings and labels
    (video_id, labels: an array in order). A video's findings are a line for each speaker and part of a proposal."""
    each = found.groupBy("video_id", "speaker", "label", "kind", "part").agg(F.max(F.struct("position", "at", "name", "parts")).alias("x"))
    rows = each.groupBy("video_id").agg(F.collect_list(F.struct("speaker", "label", "kind", "part", "x.name", "x.parts")).alias("found"))
    rows = labels.join(rows, "video_id", "left").withColumn("found", F.coalesce("found", F.array()))
    of = lambda kind: F.filter("found", lambda f: f["kind"] == kind)
    proposed = F.array_distinct(F.transform(of("part"), lambda f: F.struct(f["label"].alias("label"), f["name"].alias("name"), f["parts"].alias("parts"))))
    # a proposal counts if all its parts are said by anyone, and it is no label
    parts_by = lambda p, who: F.size(F.array_distinct(F.transform(F.filter("_parts", lambda f: (f["label"] == p["label"]) & who(f)), lambda f: f["part"]))) == F.size(p["parts"])
    rows = rows.withColumns({"_parts": of("part"), "_proposed": proposed})
    known = F.filter("_proposed", lambda p: parts_by(p, lambda f: F.lit(True)) & ~F.exists("labels", lambda x: F.lower(x) == F.lower(p["name"])))
    rows = rows.withColumn("_known", known)
    no = lambda label: F.array_position("labels", label).cast("int")
    claim = lambda strength, by, of_no, label, x: F.struct(F.lit(strength).alias("strength"), no(by).alias("by_no"), of_no.alias("of_no"), label.alias("label"), x["name"].alias("name"), x["parts"].alias("parts"), by.alias("by"))
    counts = lambda f: F.exists("_known", lambda p: p["label"] == f["label"])
    own = F.transform(of("own"), lambda f: claim(OWN, f["speaker"], F.lit(0), f["speaker"], f))
    intro = F.transform(F.filter(of("intro"), counts), lambda f: claim(INTRO, f["speaker"], no(f["label"]), f["speaker"], f))
    partner = F.transform(F.filter(of("partner"), lambda f: counts(f) & (F.size("labels") == 2)), lambda f: claim(PARTNER, f["speaker"], no(f["label"]), F.element_at("labels", 3 - no(f["speaker"])), f))
    mine = lambda p: parts_by(p, lambda f: f["speaker"] == p["label"])
    others = lambda p: parts_by(p, lambda f: f["speaker"] != p["label"])
    of_partner = lambda p: F.exists("found", lambda f: (f["kind"] == "partner") & (f["label"] == p["label"]) & (f["speaker"] == p["label"]))
    free = F.transform(F.filter("_known", lambda p: ~of_partner(p) & ~(mine(p) & ~others(p))), lambda p: claim(FREE, p["label"], no(p["label"]), p["label"], p))
    return rows.select("video_id", "labels", F.array_sort(F.concat(*(c.cast(f"array<{_CLAIM}>") for c in (own, intro, partner, free)))).alias("claims"))


def settled(listed: Column) -> Column:
    """Who holds which name after all claims, from the strongest on.

    A claim counts unless its label has a name already or, if it is made by or for others, its name has a part in common with
    one held by a stronger claim. What the other of two says replaces what a label has; it counts only from a speaker who hasn't
    named themselves.
    """

    def weigh(held: Column, c: Column) -> Column:
        named = F.exists(held, lambda h: h["label"] == c["label"])
        clash = F.exists(held, lambda h: (h["strength"] < FREE) & F.arrays_overlap(h["parts"], c["parts"]))
        speaks = F.exists(held, lambda h: (h["label"] == c["by"]) & h["own"])
        counts = F.when(c["strength"] <= INTRO, ~named).when(c["strength"] == PARTNER, ~clash & ~speaks).otherwise(~named & ~clash)
        own = (c["strength"] <= INTRO) | F.exists(held, lambda h: (h["label"] == c["label"]) & h["own"])
        new = F.array(F.struct(c["label"].alias("label"), c["name"].alias("name"), c["parts"].alias("parts"), c["strength"].alias("strength"), own.alias("own")))
        return F.when(counts, F.concat(F.filter(held, lambda h: h["label"] != c["label"]), new)).otherwise(held).cast(_HELD)

    return F.aggregate(listed, F.array().cast(_HELD), weigh)


def deal_nicknames(rows: DataFrame, seed: int = 0) -> DataFrame:
    """rows (video_id, label, used: array of names taken in the video) with a nickname each.

    A video's deck is all nicknames that nobody has there (all, if none is left), in the order of a hash of seed, video and
    nickname; a second pass through it repeats it evenly. Labels draw in order.
    """
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("label")) - 1
    all_names = F.array(*map(F.lit, NICKNAMES))
    free = F.filter(all_names, lambda n: ~F.array_contains(F.transform("used", F.lower), F.lower(n)))
    deck = F.array_sort(F.transform(F.when(F.size(free) > 0, free).otherwise(all_names), lambda n: F.struct(F.xxhash64(F.lit(seed), F.col("video_id"), n).alias("h"), n.alias("n"))))
    drawn = rows.withColumn("_deck", deck).withColumn("_place", place)
    return drawn.withColumn("nickname", F.element_at("_deck", (F.col("_place") % F.size("_deck") + 1).cast("int"))["n"]).drop("_deck", "_place")


def choose_names(segments: DataFrame, proposals: DataFrame, seed: int = 0) -> DataFrame:
    """video_id, label, name: a name of one word for every label of a video, by ``proposals`` (video_id, label, name).

    Names that two labels would have are nobody's; who has none gets a nickname.
    """
    labels = segments.where("speaker is not null").groupBy("video_id").agg(F.array_sort(F.collect_set("speaker")).alias("labels"))
    held = claims(findings(segments, proposals), labels).select("video_id", "labels", settled(F.col("claims")).alias("held"))
    once = F.filter("held", lambda h: F.size(F.filter("held", lambda o: F.lower(o["name"]) == F.lower(h["name"]))) == 1)
    known = held.select("video_id", once.alias("held"), F.explode("labels").alias("label"))
    own = F.try_element_at(F.filter("held", lambda h: h["label"] == F.col("label")), F.lit(1))["name"]
    used = F.coalesce(F.array_sort(F.transform("held", lambda h: h["name"])), F.array().cast("array<string>"))
    known = known.select("video_id", "label", own.alias("name"), used.alias("used"))
    known = stored(known, "speaker-names")  # the texts are read once
    dealt = deal_nicknames(known.where("name is null"), seed).select("video_id", "label", F.col("nickname").alias("name"))
    return known.where("name is not null").select("video_id", "label", "name").unionByName(dealt)
