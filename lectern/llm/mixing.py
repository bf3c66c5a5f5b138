"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Rows of a source, in an order by a hash of their id, are dealt into blocks. Source k has an integer weight a(k);
together the weights are the period L. Its j-th block (from 0) is released at slot floor(j L / a) and due by slot
ceil((j + 1) L / a): its share is 1 / a of the period. Earliest deadline first, among the released blocks, fills
each slot; as the weights add up to one processor, every block is placed within its window, and so after any slot
each source is less than one block from its target. After L slots all sources are even, so the schedule of one
period (L rows, made once, whose size is bound by PERIOD and MAX_SOURCES) is that of all, moved by whole periods.

All rows are kept. When a source has run out its slots stay empty, which leaves the rest in proportion.

Weights: given by source, or, by default, in proportion to the square root of the sources' row counts.

Defined cases: a null source is a source of its own, null ids come last in it and share a hash; repeated rows take
places of their own (which of two equal rows is first makes no difference); ties of deadlines go to the source
whose name is first; text isn't looked at; an empty table gives an empty result. With weights given, rows of a
source that isn't in them take part with weight DEFAULT_WEIGHT. More than MAX_SOURCES sources are an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
#: Slots of a period, about: the sum of the weights when they are rounded (each at least 1).
PERIOD = 1_000
MAX_SOURCES = 2_000
#: Most slots of a period where weights are given.
MOST_SLOTS = 20_000
DEFAULT_WEIGHT = 1
#: Rows of a source are numbered in so many runs side by side (a prefix of their hash), so that no task holds a source.
PREFIX = 3
ABSENT = "\x00"


def reduced(weights: dict[str, int]) -> dict[str, int]:
    """Whole weights divided by their common factor; a period is their sum, so larger ones than MOST_SLOTS in all are refused."""
    if any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    # sources without a weight have DEFAULT_WEIGHT, so only a factor of that as well may go
    by = math.gcd(DEFAULT_WEIGHT, *map(int, weights.values()))
    small = {k: int(w) // by for k, w in weights.items()}
    if sum(small.values()) > MOST_SLOTS:
        raise ValueError(f"weights of more than {MOST_SLOTS} in all")
    return small


def target_weights(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """One row: weights, an array of (source, a) in order of source; at most MAX_SOURCES."""
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit(ABSENT)).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        root = F.sqrt("n")
        total = counts.agg(F.sum(root).alias("total"))
        a = F.greatest(F.lit(1), F.round(root / F.col("total") * PERIOD)).cast("long")
        rows = counts.crossJoin(F.broadcast(total)).select("source", a.alias("a"))  # the other side is one row
    else:
        weights = reduced(weights)
        given = F.create_map(*(F.lit(v) for k, w in weights.items() for v in (k, int(w)))) if weights else F.lit(None).cast("map<string,int>")
        rows = counts.select("source", F.coalesce(given[F.col("source")], F.lit(DEFAULT_WEIGHT)).cast("long").alias("a"))
    few = F.when(F.count("*") <= MAX_SOURCES, F.array_sort(F.collect_list(F.struct("source", "a")))).otherwise(F.raise_error(F.lit(f"more than {MAX_SOURCES} sources")))
    return rows.orderBy("source").limit(MAX_SOURCES + 1).agg(few.alias("weights"))


def schedule(weights: DataFrame) -> DataFrame:
    """One period: source, a, period, j (block of the source in the period), release, deadline, slot."""
    period = F.aggregate("weights", F.lit(0).cast("long"), lambda acc, x: acc + x["a"])
    w = weights.where(F.size("weights") > 0).withColumn("period", period)

    def step(state: Column, slot: Column) -> Column:
        # the released block with the earliest deadline: (deadline, index) of each source whose block j is released
        def offer(x: Column, k: Column) -> Column:
            j = F.element_at(state["placed"], (k + 1).cast("int"))
            released = F.floor(j * F.col("period") / x["a"]) <= slot
            return F.when(released, F.struct(F.ceil((j + 1) * F.col("period") / x["a"]).cast("long").alias("deadline"), k.cast("int").alias("k"), j.alias("j")))

        best = F.array_min(F.filter(F.transform("weights", offer), lambda x: x.isNotNull()))
        placed = F.transform(state["placed"], lambda n, k: n + F.when(k == best["k"], F.lit(1)).otherwise(F.lit(0)))
        return F.struct(placed.cast("array<long>").alias("placed"), F.concat(state["out"], F.array(F.struct(best["k"].alias("k"), best["j"].alias("j"), slot.alias("slot")))).alias("out"))

    start = F.struct(F.transform("weights", lambda x: F.lit(0).cast("long")).alias("placed"), F.expr("cast(array() as array<struct<k:int,j:bigint,slot:bigint>>)").alias("out"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, step, lambda s: s["out"])
    rows = w.withColumn("b", F.explode(run)).withColumn("x", F.element_at("weights", F.col("b.k") + 1))
    return rows.select(
        F.col("x.source").alias("source"), F.col("x.a").alias("a"), "period", F.col("b.j").alias("j"),
        F.floor(F.col("b.j") * F.col("period") / F.col("x.a")).alias("release"), F.ceil((F.col("b.j") + 1) * F.col("period") / F.col("x.a")).alias("deadline"), F.col("b.slot").alias("slot"),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, and _n: each row's number (from 0) within its source in order of hash and id.

    A hash's first digits name a run; rows are numbered within runs, and runs start where those before end. Rows without an id
    go by a hash of all they have, so that these too are many runs.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.xxhash64(*docs.columns).cast("string"))))
    d = docs.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit(ABSENT))).withColumn("_key", key).withColumn("_run", F.substring("_key", 1, PREFIX))
    counts = d.groupBy("_source", "_run").agg(F.count("*").alias("_many"))
    before = Window.partitionBy("_source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_source", "_run", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_source", "_run").orderBy("_key", F.col("doc_id").asc_nulls_last()))
    return d.withColumn("_inside", inside).join(starts, ["_source", "_run"]).withColumn("_n", F.col("_start") + F.col("_inside") - 1)


def mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with block, release, deadline and slot (of the whole run), and row_in_block: sorted by slot and
    row_in_block, they are the mix."""
    block = F.floor(F.col("_n") / block_rows)
    n = numbered(docs).withColumn("_block", block)
    plan = schedule(target_weights(docs, weights)).select(F.col("source").alias("_s"), F.col("a").alias("_a"), F.col("period").alias("_period"), F.col("j").alias("_j"), F.col("release").alias("_release"), F.col("deadline").alias("_deadline"), F.col("slot").alias("_slot"))
    shares = target_weights(docs, weights).select(F.explode("weights").alias("w")).select(F.col("w.source").alias("_source"), F.col("w.a").alias("_share"))
    placed = n.join(F.broadcast(shares), "_source").withColumn("_at", F.col("_block") % F.col("_share"))  # MAX_SOURCES rows at most
    placed = placed.join(F.broadcast(plan), (F.col("_source") == F.col("_s")) & (F.col("_at") == F.col("_j")))  # about PERIOD + MAX_SOURCES rows at most
    moved = F.floor(F.col("_block") / F.col("_a")) * F.col("_period")
    return placed.select(
        *(placed[c] for c in docs.columns), F.col("_block").cast("long").alias("_mix_block"), (F.col("_release") + moved).cast("long").alias("_mix_release"), (F.col("_deadline") + moved).cast("long").alias("_mix_deadline"),
        (F.col("_slot") + moved).cast("long").alias("_mix_slot"), (F.col("_n") % block_rows).cast("long").alias("_mix_row"),
    )


def mix(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """The documents in mixed order: range-partitioned and sorted by slot, so that files, read in order, are the mix."""
    packed = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))  # other columns can't clash with those made here
    ordered = mixed_order(packed, weights).select("_row", "_mix_slot", "_mix_row")
    return ordered.repartitionByRange("_mix_slot", "_mix_row").sortWithinPartitions("_mix_slot", "_mix_row").select("_row.*")


def placed(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with slot and row_in_block, the places that mix() gives the rows (of rows equal in source and id, either's)."""
    return mixed_order(docs, weights).select(*docs.columns, F.col("_mix_slot").alias("slot"), F.col("_mix_row").alias("row_in_block"))


def query(docs: DataFrame) -> DataFrame:
    out = mixed_order(docs.select("doc_id", "source"))
    return out.select("doc_id", "source", F.col("_mix_block").alias("block"), F.col("_mix_release").alias("release"), F.col("_mix_deadline").alias("deadline"), F.col("_mix_slot").alias("slot"), F.col("_mix_row").alias("row_in_block"))


#: DuckDB: the same schedule by recursion over the slots of one period.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(CAST(source AS VARCHAR), chr(1)) AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
counts AS (SELECT s, count(*) AS n FROM d GROUP BY s),
w AS (SELECT s, CAST(greatest(1, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * {PERIOD})) AS BIGINT) AS a FROM counts),
p AS (SELECT list(struct_pack(s := s, a := a) ORDER BY s) AS ws, CAST(sum(a) AS BIGINT) AS period FROM w),
sched(slot, placed, k, j) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM p WHERE len(ws) > 0
  UNION ALL
  SELECT slot + 1, list_transform(placed, lambda n, i: CASE WHEN i = best.i THEN n + 1 ELSE n END), best.i, best.j
  FROM (
    SELECT t.slot, t.placed, p.period, list_min(list_filter(list_transform(p.ws, lambda x, i:
        CASE WHEN (t.placed[i] * p.period) // x.a <= t.slot + 1
        THEN struct_pack(d := ((t.placed[i] + 1) * p.period + x.a - 1) // x.a, i := CAST(i AS BIGINT), j := t.placed[i]) END), lambda x: x IS NOT NULL)) AS best
    FROM sched t, p WHERE t.slot + 1 < p.period)),
plan AS (SELECT ws[k].s AS s, ws[k].a AS a, j, slot, period FROM sched, p WHERE slot >= 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id NULLS LAST) - 1 AS n FROM d)
SELECT doc_id, source, CAST(n // {BLOCK_ROWS} AS BIGINT) AS block,
  CAST((n // {BLOCK_ROWS}) * period // plan.a AS BIGINT) AS release, CAST((((n // {BLOCK_ROWS}) + 1) * period + plan.a - 1) // plan.a AS BIGINT) AS deadline,
  CAST(slot + (n // {BLOCK_ROWS}) // plan.a * period AS BIGINT) AS slot, CAST(n % {BLOCK_ROWS} AS BIGINT) AS row_in_block
FROM numbered JOIN plan ON plan.s = numbered.s AND plan.j = (n // {BLOCK_ROWS}) % plan.a
"""
