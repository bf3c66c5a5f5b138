"""Ordered folds: results that depend on where the previous cut fell.

Parts that are cut by a threshold since the last cut are folded in blocks of a key's rows by functions over arrays, all
blocks at once (block_fold). What needs a larger state streams through Arrow batches with one key's state
(ordered_fold). Only numbers move: texts are joined back where they are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clock
from ..sources.scratch import stored

CHAPTER_MS, WINDOW_MS, ATOM_MS, TOPIC_MS = 50_000, 600_000, 150_000, 360_000


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], begin: Callable, step: Callable, out: str) -> DataFrame:
    """keys and the columns of `out` (DDL): the tuples that step(state, *fields) yields for a key's rows in order.

    begin() makes the state of a key.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            rows = []
            for row in zip(*(batch[c].tolist() for c in [*keys, *fields])):
                if row[: len(keys)] != at:
                    at, state = row[: len(keys)], begin()
                rows += [(*at, *made) for made in step(state, *row[len(keys) :])]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    dealt = df.select(*dict.fromkeys([*keys, *order, *fields])).repartition(*keys).sortWithinPartitions(*keys, *order)
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInPandas(run, f"{types}, {out}")


#: Rows of a block at most, as positions are whole numbers.
BLOCK = 8_192


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def array_fold(df: DataFrame, keys: list[str], place: str, state: str, step: Callable[[Column, Column], Column], emitted: str) -> DataFrame:
    """The rows of ``df`` with what a fold over each key's rows, in order of ``place`` (whole numbers), gives for each: no and out.

    step(s, r) is, of the state s before row r (null at first), a struct of begins (does a new part begin? no counts these),
    out (what to give out, of type ``emitted``) and s, the new state (of type ``state``). Rows are gathered in blocks of BLOCK places, an array each, and folded
    there by built-in functions. A key of several blocks is folded in all of them at once, each from the state that the
    block before has ended in so far, until no block's beginning changes: folds that forget soon fall together, so a
    few rounds do; at worst one a block. No step has more of a key than a block in one row.
    """
    fields = [c for c in df.columns if c not in (*keys, place)]
    row = F.struct(F.col(place).cast("long").alias("place"), *fields)
    blocks = df.groupBy(*keys, F.floor(F.col(place) / BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    begun = F.lit(None).cast(state)

    def walked(entry: Column) -> Column:
        """The state after the block's rows."""
        return F.aggregate("_rows", entry, lambda s, r: step(s, r)["s"].cast(state))

    def told(entry: Column) -> Column:
        """For each row the number of parts begun in the block so far, and what is given out."""
        kind = f"struct<s: {state}, no: bigint, out: array<struct<no: bigint, out: {emitted}>>>"
        zero = F.struct(entry.alias("s"), F.lit(0).cast("long").alias("no"), F.array().alias("out")).cast(kind)

        def add(acc: Column, r: Column) -> Column:
            more = lambda x: F.struct((acc["no"] + x["begins"].cast("long")).alias("no"), x["out"].cast(emitted).alias("out"))
            return let(step(acc["s"], r), lambda x: F.struct(x["s"].alias("s"), (acc["no"] + x["begins"].cast("long")).alias("no"), F.concat(acc["out"], F.array(more(x))).alias("out")).cast(kind))

        return F.aggregate("_rows", zero, add, lambda acc: acc["out"])

    if not df.where(F.floor(F.col(place) / BLOCK) != 0).limit(1).isEmpty():
        before = Window.partitionBy(*keys).orderBy("_block")
        blocks = stored(blocks, "fold-blocks")
        ends = stored(blocks.select(*keys, "_block", begun.alias("entry"), walked(begun).alias("exit")), "fold-ends")
        while True:
            now = ends.withColumn("_new", F.lag("exit").over(before))
            now = stored(now.withColumn("_moved", ~F.col("_new").eqNullSafe(F.col("entry"))), "fold-entries")
            if now.where("_moved").isEmpty():
                break
            again = now.where("_moved").select(*keys, "_block", F.col("_new").alias("entry")).join(blocks, [*keys, "_block"]).select(*keys, "_block", "entry", walked(F.col("entry")).alias("exit"))
            ends = stored(now.where("not _moved").select(*keys, "_block", "entry", "exit").unionByName(again), "fold-ends")
        blocks = blocks.join(ends.select(*keys, "_block", "entry"), [*keys, "_block"]).withColumn("_told", told(F.col("entry")))
        begun_in = blocks.select(*keys, "_block", F.element_at("_told", -1)["no"].alias("_n"))
        base = begun_in.select(*keys, "_block", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        blocks = blocks.join(base, [*keys, "_block"])
    else:
        blocks = blocks.withColumn("_told", told(begun)).withColumn("_base", F.lit(0).cast("long"))
    each = blocks.select(*keys, "_base", F.explode(F.arrays_zip("_rows", "_told")).alias("x"))
    return each.select(*keys, F.col("x._rows.place").alias(place), *(F.col(f"x._rows.{c}").alias(c) for c in fields), (F.col("_base") + F.col("x._told.no")).alias("no"), F.col("x._told.out").alias("out"))


def block_fold(df: DataFrame, keys: list[str], place: str, cut: Callable[[Column, Column], Column], moved: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys, place, start_ms, end_ms, no and origin: parts of a key's rows, and where each row's part began.

    cut(s, r) tells whether row r begins a new part, s being the open one (origin, and end_ms and speaker of its last row);
    moved(s) whether the open one begins at r after all.
    """

    def step(s: Column, r: Column) -> Column:
        def begun(cuts: Column) -> Column:
            begins = s.isNull() | cuts if moved is None else s.isNull() | cuts | moved(s)
            origin = F.when(begins, r["start_ms"]).otherwise(s["origin"])
            state = F.struct(origin.alias("origin"), r["end_ms"].alias("end_ms"), (r["speaker"] if "speaker" in df.columns else F.lit("")).alias("speaker"))
            return F.struct(cuts.alias("begins"), F.struct(origin.alias("origin")).alias("out"), state.alias("s"))

        return let(s.isNotNull() & cut(s, r), begun)

    told = array_fold(df, keys, place, "struct<origin: bigint, end_ms: bigint, speaker: string>", step, "struct<origin: bigint>")
    return told.select(*keys, place, "start_ms", "end_ms", "no", F.col("out.origin").alias("origin"))


def _rejoined(parts: DataFrame, keys: list[str], part: str, least_ms: int) -> DataFrame:
    """A key's last part joins the one before where it spans less than least_ms."""
    spans = parts.groupBy(*keys, part).agg(F.min_by("start_ms", "position").alias("_a"), F.max_by("end_ms", "position").alias("_z"))
    last = F.lead(part).over(Window.partitionBy(*keys).orderBy(part)).isNull()
    short = spans.withColumn("_last", last).where((F.col(part) > 0) & F.col("_last") & (F.col("_z") - F.col("_a") < least_ms)).select(*keys, part, F.lit(1).alias("_back"))
    return parts.join(short, [*keys, part], "left").withColumn(part, F.col(part) - F.coalesce("_back", F.lit(0))).drop("_back")


def topic_chapters(segments: DataFrame) -> DataFrame:
    """video_id, position, start_ms, end_ms, chapter_no: cut at 600 s, or from 50 s on at a pause of 2.5 s, or of 1 s with a new speaker."""

    def cut(s: Column, r: Column) -> Column:
        covered, gap = s["end_ms"] - s["origin"], r["start_ms"] - s["end_ms"]
        return (covered >= WINDOW_MS) | (covered >= CHAPTER_MS) & ((gap >= 2500) | (gap >= 1000) & (r["speaker"] != s["speaker"]))

    told = segments.select("video_id", "position", "start_ms", "end_ms", F.coalesce("speaker", F.lit("")).alias("speaker"))
    parts = block_fold(told, ["video_id"], "position", cut).drop("origin").withColumnRenamed("no", "chapter_no")
    return _rejoined(parts, ["video_id"], "chapter_no", CHAPTER_MS)


def topic_atoms(segments: DataFrame) -> DataFrame:
    """video_id, chapter_no, position, start_ms, end_ms, atom_no (within the chapter): cut from 50 s on where a row would pass 150 s."""
    keys = ["video_id", "chapter_no"]
    cut = lambda s, r: (s["end_ms"] - s["origin"] >= CHAPTER_MS) & (r["end_ms"] - s["origin"] > ATOM_MS)
    parts = block_fold(topic_chapters(segments), keys, "position", cut).drop("origin").withColumnRenamed("no", "atom_no")
    return _rejoined(parts, keys, "atom_no", CHAPTER_MS)


def topic_groups(atoms: DataFrame, verdicts: DataFrame) -> DataFrame:
    """video_id, atom_no, start_ms, end_ms, topic_no: atoms grouped by verdicts, then cut at 360 s.

    atoms: video_id, atom_no (over the video), start_ms, end_ms. verdicts: video_id, atom_no, is_start; an atom without
    one starts a topic, as the first does.
    """
    told = atoms.select("video_id", "atom_no", "start_ms", "end_ms").join(verdicts.select("video_id", "atom_no", "is_start"), ["video_id", "atom_no"], "left").withColumn("is_start", F.coalesce("is_start", F.lit(True)))
    cut = lambda s, r: r["is_start"] | (r["end_ms"] - s["origin"] > TOPIC_MS)
    return block_fold(told, ["video_id"], "atom_no", cut).select("video_id", "atom_no", "start_ms", "end_ms", F.col("no").alias("topic_no"))


def windows(segments: DataFrame, most_chars: int = 7000, carry_ms: int = 30_000) -> DataFrame:
    """video_id, window_no, position, carried: windows of 600 s and most_chars (16 more a row) at most.

    A window repeats the rows of the previous one's last 30 s, unless a longer pause lies between, they pass a quarter of
    most_chars, or they are all of it. The state is a window's rows, so bounded by most_chars.
    """

    def step(s, position, start, end, chars):
        size = chars + 16
        if not s:
            s.update(no=0, origin=start, rows=[], fresh=0, chars=0)
        if s["fresh"] and (start >= s["origin"] + WINDOW_MS or s["chars"] + size > most_chars):
            last = s["rows"][-1][2]
            tail = [r for r in s["rows"] if r[1] >= last - carry_ms]
            heavy = sum(r[3] for r in tail) > most_chars // 4
            if start - last > carry_ms or heavy or len(tail) == len(s["rows"]):
                tail = []
            s.update(no=s["no"] + 1, rows=tail, fresh=0, chars=sum(r[3] for r in tail), origin=tail[0][1] if tail else start)
            for r in tail:
                yield s["no"], r[0], True
        s["rows"].append((position, start, end, size))
        s["fresh"] += 1
        s["chars"] += size
        yield s["no"], position, False

    told = segments.withColumn("chars", F.length("text"))
    return ordered_fold(told, ["video_id"], ["position"], ["position", "start_ms", "end_ms", "chars"], dict, step, "window_no long, position long, carried boolean")


def pack_speech(regions: DataFrame, max_ms: int = 22_000, min_ms: int = 15_000, strict_ms: int = 30_000, new_ms: int = 200) -> DataFrame:
    """video_id, piece_no, part_no, start_ms, end_ms (double): speech regions (video_id, region_no, start_ms, end_ms) in pieces.

    A piece over new_ms closes where the next region would carry it past max_ms, or it is past min_ms already; one over
    strict_ms is cut into equal parts; a last one of new_ms or less is dropped.
    """

    def cut(s: Column, r: Column) -> Column:
        long = s["end_ms"] - s["origin"]
        return (long > new_ms) & ((long + r["end_ms"] - s["end_ms"] > max_ms) | (long > min_ms))

    regions = regions.select("video_id", "region_no", "start_ms", "end_ms")
    packed = block_fold(regions, ["video_id"], "region_no", cut, moved=lambda s: s["end_ms"] == s["origin"]).select("video_id", "region_no", F.col("no").alias("piece_no"), F.col("origin").alias("start_ms"), "end_ms")
    pieces = packed.groupBy("video_id", "piece_no").agg(F.max_by("start_ms", "region_no").alias("a"), F.max_by("end_ms", "region_no").alias("z")).where(F.col("z") - F.col("a") > new_ms)
    long = F.col("z") - F.col("a")
    cut = pieces.withColumn("n", F.when(long > strict_ms, F.floor(long / strict_ms) + 1).otherwise(1)).withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda k: F.col("a") + k * long / F.col("n")
    return cut.select("video_id", "piece_no", "part_no", at(F.col("part_no")).alias("start_ms"), at(F.col("part_no") + 1).alias("end_ms"))


def fold_repeats(entries: DataFrame, verdicts: DataFrame, same: float = 0.92, twin: float = 0.97, apart_ms: int = 60_000) -> DataFrame:
    """index_id, id, start_ms, end_ms, text, members, changed: points told at several places, as one entry each.

    In order of (start_ms, end_ms, id) an entry joins the group whose first member is most similar, from `same` on (the
    later group of equals). A group all of whose members reach `twin` keeps its longest text (the first of equals); another takes the text
    of its verdict (index_id, id of the first member, text), or its members stay apart. Marks closer than apart_ms are
    one; several are named after the text. The state holds the groups' first vectors of one index.
    """

    def begin():
        return {"lead": np.empty((16, 0)), "n": 0, "marks": []}

    def step(s, id_, start, vector):
        v = np.asarray(vector, dtype=float)
        if not s["lead"].shape[1]:
            s["lead"] = np.zeros((16, len(v)))
        near = s["lead"][: s["n"]] @ v
        best = s["n"] - 1 - int(np.argmax(near[::-1])) if s["n"] else -1
        if best >= 0 and near[best] >= same:
            close, mark = float(near[best]), start - s["marks"][best] >= apart_ms
        else:
            if s["n"] == len(s["lead"]):
                s["lead"] = np.concatenate([s["lead"], np.zeros_like(s["lead"])])
            best, close, mark = s["n"], 1.0, True
            s["lead"][best], s["n"] = v, s["n"] + 1
            s["marks"].append(start)
        if mark:
            s["marks"][best] = start
        yield id_, best, close, mark

    known = entries.where("embedding is not null")
    order = ["start_ms", "end_ms", "id"]
    dealt = ordered_fold(known, ["index_id"], order, ["id", "start_ms", "embedding"], begin, step, "id long, group_no long, close double, mark boolean")
    rows = entries.join(dealt, ["index_id", "id"], "left").withColumn("group_no", F.coalesce("group_no", -1 - F.col("id")))
    place = F.struct(*order)
    marks = F.transform(F.array_sort(F.collect_list(F.when(F.col("mark"), place))), lambda m: clock(m["start_ms"] / 1000))
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("start_ms"), -F.col("end_ms"), -F.col("id")))
    groups = rows.groupBy("index_id", "group_no").agg(
        F.min(place).alias("first"), F.min_by("text", place).alias("first_text"), longest.alias("longest"), F.min("close").alias("close"), F.count("*").alias("members"), marks.alias("marks")
    )
    said = verdicts.select(F.col("index_id").alias("_index"), F.col("id").alias("_lead"), F.col("text").alias("verdict"))
    told = groups.join(said, (F.col("index_id") == F.col("_index")) & (F.col("first.id") == F.col("_lead")), "left")
    text = F.when(F.col("members") == 1, F.col("first_text")).when(F.col("close") >= twin, F.col("longest")).otherwise(F.col("verdict"))
    told = told.withColumn("text", text)
    named = F.when((F.col("members") > 1) & (F.size("marks") > 1), F.substring(F.concat("text", F.lit(" Звучит: "), F.array_join("marks", ", "), F.lit(".")), 1, 600)).otherwise(F.col("text"))
    whole = told.where("text is not null or members = 1").select("index_id", "first.id", "first.start_ms", "first.end_ms", named.alias("text"), "members", (~F.col("first_text").eqNullSafe(named)).alias("changed"))
    apart = rows.join(told.where("text is null and members > 1").select("index_id", "group_no"), ["index_id", "group_no"], "left_semi")
    return whole.union(apart.select("index_id", "id", "start_ms", "end_ms", "text", F.lit(1).cast("long").alias("members"), F.lit(False).alias("changed")))
