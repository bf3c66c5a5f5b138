"""N-gram Jaccard join: all pairs of texts whose sets of word n-grams overlap enough, as components.

The work is on distinct sets (texts with equal sets are one vertex). A pair that links differs in D elements at
most, a number that follows from the two sizes. Sizes are cut into bands so that partners are in the same or the
next band; a band and the next make a tile, with one D for the tile. In a tile every set is split by ranges of its
hashes into more than D parts: a pair that links has one part at least where it is equal. So all candidates are met among
the sets with an equal part (same tile, number and content of the part), and sets that only share some common passage
seldom meet.

A first pass over the texts counts which parts several sets have, in a partial aggregate, and marks them in a bit table
of fixed size (SHARED_BITS); a second pass keeps, of each set, the parts that are marked (a false mark costs a row, no
result), and the elements of the sets that have any.

Groups of an equal part may be large where there are many near copies. Round 1 checks one link for each set, to the
set of its groups that shares most parts with others, as an original does, exactly, by intersecting sorted arrays. The
next rounds look at the groups that still have sets of different components: hashed bitmaps (each bit the parity of its
elements) are compared; the bits in which two bitmaps differ bound the overlap from above. Each set outside its group's
largest component proposes one partner, the nearest that its bitmap allows, and the proposals are checked exactly. When
a round has made no link, the sets that still have allowed partners are compared with all of these, exactly and where they stand:
a task gives only links between what it hasn't linked yet. Pairs in one component already need no look, as the result is
components.

A group beyond SPLIT_BLOCKS blocks of BLOCK rows, as many sets with one passage in common may make, is split again before anything is compared: its sets
are cut into twice as many and smaller parts, of which a pair that links has more than half in common, so the two have one in
common among each one's rarest half (by how many of these sets have a part). Sets that are otherwise unlike have
enough parts of their own and no longer meet. A group beyond one block is dealt as rectangles of BLOCK by BLOCK, each row to
as many as the group has blocks, or blocks of other components' rows. Only families of sets that all nearly link stay beyond
SPLIT_BLOCKS after the second split, and for them alone the rows dealt grow faster than the rows.

Defined cases: no words or no text: an empty set that links with nothing, its own component; fewer words than n: the
whole sequence is the one n-gram; repeated rows share a vertex; a null id takes part, but isn't a component's name
unless all ids of the component are null; extra columns don't matter. Sets are named by 63 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, WordHashes, mixed, schema_of, stored, temporary
from .components import components

#: Rows of a group that are compared with others in one piece.
BLOCK = 1_024
#: Groups beyond as many blocks are split again by smaller parts; up to that a row is dealt to as many rectangles at most, and once more as a target.
SPLIT_BLOCKS = 4
#: Groups up to this size are compared many at a time.
SMALL = 6
#: Marks of parts that several sets have (a sixteenth of a byte for each of 2^27 hashes); more parts make more false marks.
SHARED_BITS = 1 << 27
#: Ids up to this number are broadcast (8 bytes each); beyond it they are joined by a shuffle.
SENT_IDS = 2_000_000
#: Bytes of elements up to which the sets at one end of the pairs are broadcast; beyond them they are joined by a shuffle.
SENT_BYTES = 64 << 20
#: Bits of a set's bitmap: two to four for each element, within these.
LEAST_BITS, MOST_BITS = 64, 65_536


@dataclass(frozen=True)
class Rule:
    """n-grams of ``n`` words; a pair links when den * intersection >= num * union."""

    n: int
    num: int
    den: int

    def most_apart(self, total: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of two sets that link, by the sum of their sizes."""
        total = np.asarray(total, np.int64)
        return total - 2 * -(-self.num * total // (self.num + self.den))

    def bands(self) -> np.ndarray:
        """Least sizes of the bands."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out, np.int64)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """By the tile that each band begins: parts of its sets, and elements in which a linked pair differs at most.

        Parts are more than the elements by 1 and by about as many as are empty in a set of the band's least size:
        two sets that link then have an equal part that isn't empty, unless both have that many empty ones.
        """
        least = self.bands()
        top = least * self.den // self.num
        apart = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        k = apart + 1
        for _ in range(2):
            empty = k * np.exp(-least / k)
            k = np.maximum(k, apart + 1 + np.where(apart > 0, np.ceil(empty + 3 * np.sqrt(empty)), 0).astype(np.int64))
        return k, apart


def set_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        return mixed(*(hashes[i : i + 1] for i in range(len(hashes))), np.array([len(hashes)], np.uint64))
    return np.unique(mixed(*(hashes[i : len(hashes) - n + 1 + i] for i in range(n))))


def vertex_of(s: np.ndarray) -> int:
    """The set's id; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 or 1 if len(s) else 0


def bitmap_of(s: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 2 << int(len(s)).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def keys_of(s: np.ndarray, bands: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of (tile, number, content) of the set's parts, in the tiles of its band and of the band before.

    Of k parts, at most D differ in a pair that links, so k - D are equal. A set with fewer empty parts than that has
    one among the equal ones that isn't empty; only sets with as many or more give keys for their empty parts too.
    """
    band = int(np.searchsorted(bands, len(s), side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * np.uint64(0x94D049BB133111EB) ^ (s >> np.uint64(31)), dtype=np.uint64)])
    out = []
    for tile in (band, band - 1):
        if tile < 0:
            continue
        k, apart = int(parts[0][tile]), int(parts[1][tile])
        edges = np.searchsorted(s, np.arange(k, dtype=np.uint64) * np.uint64((1 << 64) // k if k > 1 else 0))
        if k == 1:
            edges[0] = 0
        at = np.concatenate([edges, [len(s)]])
        content, size = sums[at[1:]] - sums[at[:-1]], np.diff(at)
        keys = mixed(content, size.astype(np.uint64), np.arange(k, dtype=np.uint64), np.full(k, tile, np.uint64))
        out.append(keys if k - np.count_nonzero(size) >= k - apart else keys[size > 0])
    return np.concatenate(out).view(np.int64)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(at, SLICE_ROWS)
            yield part, part.column("text").cast(pa.binary()).to_pylist()


class Seen(set):
    """Ids that a task has met, as far as they are held: at most a million."""

    def new(self, v: int) -> bool:
        if v in self:
            return False
        if len(self) >= 1_000_000:
            self.clear()
        self.add(v)
        return True


def shared_parts(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Marks (bytes of bits) of the keys that several sets have: by the low bits of the key, SHARED_BITS of them.

    Only keys are counted, so those of a set that two tasks have met are marked too: copies cost a row each, no result.
    """
    schema = schema_of("key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, bands, parts = WordHashes(), Seen(), rule.bands(), rule.parts()
        for _, texts in text_slices(batches):
            keys = [np.empty(0, np.int64)]
            for t in texts:
                s = set_of(hashes.of((t or b"").lower().split()), rule.n)
                if len(s) and seen.new(vertex_of(s)):
                    keys.append(np.unique(keys_of(s, bands, parts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=schema.names)

    keyed = docs.select("text").mapInArrow(run, schema)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    at = F.pmod("key", F.lit(SHARED_BITS)) + 1  # bit places count from 1
    marks = stored(shared.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), "jaccard-parts")
    out = np.zeros(SHARED_BITS // 8, np.uint8)
    for r in marks.collect():  # 4 kB for each 2^15 bits: 16 MB at most, whatever the input
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def described(docs: DataFrame, rule: Rule, marks: np.ndarray) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles and vid of each row; once in a task for each vid that has marked
    keys, these, and place (of the row, by task), bitmap and elements."""
    schema = T.StructType([docs.schema["doc_id"], *schema_of("text_key long, n_shingles long, vid long, place long, keys array<long>, bitmap binary, elements binary").fields])
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, bands, parts, marked = WordHashes(), Seen(), rule.bands(), rule.parts(), sent.value
        place = TaskContext.get().partitionId() << 40
        for part, texts in text_slices(batches):
            sets = [set_of(hashes.of((t or b"").lower().split()), rule.n) for t in texts]
            vids = [vertex_of(s) for s in sets]
            keys, maps, elements = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for i, (v, s) in enumerate(zip(vids, sets, strict=True)):
                if len(s) and seen.new(v):
                    k = np.unique(keys_of(s, bands, parts))
                    at = k & (SHARED_BITS - 1)
                    k = k[(marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                    if len(k):
                        keys[i], maps[i], elements[i] = k, bitmap_of(s), s.tobytes()
            places = np.arange(place, place + len(sets))
            place += len(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(vids, pa.int64()), pa.array(places, pa.int64())]
                + [pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(elements, pa.binary())],
                names=schema.names,
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, schema)


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df``, with a broadcast hint if it has SENT_IDS rows at most."""
    return F.broadcast(df) if df.limit(SENT_IDS + 1).count() <= SENT_IDS else df


def of_ids(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of these ids (vid)."""
    return sets.join(sent_if_few(ids), "vid", "left_semi")


def once_each(rows: DataFrame) -> DataFrame:
    """Of ``rows`` with keys one for each vid, the first by place: tasks know of their own rows only."""
    own = rows.where("keys is not null")
    several = stored(own.groupBy("vid").agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("vid", "_first"), "jaccard-several")
    return own.join(sent_if_few(several), "vid", "left").where("_first is null or place = _first").drop("_first", "place")


def linked(x: pa.Buffer, y: pa.Buffer, rule: Rule) -> bool:
    """Do two sorted arrays of elements overlap enough?"""
    s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([s, t])
    both.sort(kind="stable")  # two sorted runs
    inter = int((both[1:] == both[:-1]).sum())
    return rule.den * inter >= rule.num * (len(s) + len(t) - inter)


def checked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b; each a in few) that link, by exact intersection. The pairs go to the elements of their a, where they are
    few enough to be sent, and only these then move to their b."""
    schema = schema_of("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(x.as_buffer(), y.as_buffer(), rule) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # elements are the bulk: pairs are sent to those of a, and of the others only those of some b are moved, or sent where they are small
    pairs = stored(pairs, "jaccard-pairs")
    ends = stored(of_ids(sets, pairs.select(F.col("b").alias("vid")).distinct()).select(F.col("vid").alias("b"), F.col("elements").alias("y")), "jaccard-ends")
    size = ends.agg(F.sum(F.length("y") + 64)).first()[0] or 0
    full = sets.select(F.col("vid").alias("a"), F.col("elements").alias("x")).join(sent_if_few(pairs), "a").join(F.broadcast(ends) if size <= SENT_BYTES else ends, "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, schema)


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one length (the shortest's): longer ones are folded, which keeps the bound."""
    size = min(map(len, maps))
    out = np.empty((len(maps), size // 8), np.uint64)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def allowed(pairs: DataFrame, marks: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that sizes and bitmaps (marks: vid, size, bitmap) don't rule out."""
    schema = schema_of("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in "mn")
            maps = [folded(list(two)) for two in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            apart = np.array([np.bitwise_count(x ^ y).sum() for x, y in maps], np.int64)
            ok = (apart <= rule.most_apart(m + n)) & (np.minimum(m, n) * rule.den >= np.maximum(m, n) * rule.num)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = stored(pairs, "jaccard-star")
    # many share a hub: only the hubs' bitmaps are moved
    hubs = of_ids(marks, pairs.select(F.col("b").alias("vid")).distinct()).select(F.col("vid").alias("b"), F.col("size").alias("n"), F.col("bitmap").alias("y"))
    full = marks.select(F.col("vid").alias("a"), F.col("size").alias("m"), F.col("bitmap").alias("x")).join(sent_if_few(pairs), "a").join(hubs, "b")
    return full.select("a", "b", "m", "n", "x", "y").mapInArrow(run, schema)


class Group:
    """Rows of a group or a rectangle of one: the probes are compared with the targets of other components."""

    def __init__(self, table: pa.Table, at: int, to: int) -> None:
        part = table.slice(at, to - at)
        self.vid, self.comp, self.size, self.probe, self.target = (part.column(k).to_numpy() for k in ("vid", "comp", "size", "probe", "target"))
        self.bits = folded(part.column("bitmap").to_pylist())
        self.part = part

    def pairs(self, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(probe, target, bits apart) of the pairs that sizes and bitmaps don't rule out, a piece at a time, by probe."""
        probes, targets = np.flatnonzero(self.probe), np.flatnonzero(self.target)
        step = max(1, (1 << 22) // max(1, len(targets) * self.bits.shape[1]))
        size, comp, bits = self.size[targets], self.comp[targets], self.bits[targets]
        for at in range(0, len(probes), step):
            p = probes[at : at + step]
            apart = np.bitwise_count(self.bits[p][:, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
            own = self.size[p][:, None]
            ok = (apart <= rule.most_apart(own + size[None, :])) & (np.minimum(own, size) * rule.den >= np.maximum(own, size) * rule.num) & (self.comp[p][:, None] != comp[None, :])
            i, j = np.nonzero(ok)
            yield p[i], targets[j], apart[i, j]


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (key, i, j) of sorted rows, and where these start, with the end."""
    held: list[pa.RecordBatch] = []

    def starts_of(table: pa.Table) -> np.ndarray:
        k, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        return np.concatenate([[0], 1 + np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate([starts_of(table), [table.num_rows]])


def small_pairs(table: pa.Table, starts: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group.pairs of all groups of SMALL rows at most at a time: (row, row, bits apart), each pair once."""
    size, comp = table.column("size").to_numpy(), table.column("comp").to_numpy()
    length = np.diff(starts)
    group = np.repeat(np.arange(len(length)), length)
    group[np.repeat(length > SMALL, length)] = -1
    left, right = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero((group[d:] == group[:-d]) & (group[d:] >= 0) & (comp[d:] != comp[:-d]))
        i = i[np.minimum(size[i], size[i + d]) * rule.den >= np.maximum(size[i], size[i + d]) * rule.num]
        left.append(i)
        right.append(i + d)
    a, b = np.concatenate(left), np.concatenate(right)
    maps = table.column("bitmap").combine_chunks()
    if isinstance(maps, pa.ChunkedArray):
        maps = maps.chunk(0)
    offsets, data = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1], np.frombuffer(maps.buffers()[2], np.uint8)
    wide = np.diff(offsets)
    apart = np.empty(len(a), np.int64)
    for x, y in {*zip(wide[a].tolist(), wide[b].tolist(), strict=True)}:
        here = np.flatnonzero((wide[a] == x) & (wide[b] == y))
        for at in range(0, len(here), step := max(1, (1 << 24) // max(x, y))):
            h, least = here[at : at + step], min(x, y)
            m, n = (np.bitwise_xor.reduce(data[offsets[r[h]][:, None] + np.arange(w)].reshape(len(h), -1, least), axis=1) for r, w in ((a, x), (b, y)))
            apart[h] = np.bitwise_count(m ^ n).sum(axis=1, dtype=np.int64)
    ok = apart <= rule.most_apart(size[a] + size[b])
    return a[ok], b[ok], apart[ok]


def dealt(split: DataFrame) -> DataFrame:
    """Rows of groups that have several components, by (key, i, j): whole groups up to BLOCK rows, others as rectangles.

    split: key, vid, comp, size, bitmap (and what else goes along), and of the key top (its largest component), many
    (rows) and outside (rows of other components, the probes). A rectangle has BLOCK probes by BLOCK targets.
    """
    probe = F.col("comp") != F.col("top")
    across, down = F.ceil(F.col("many") / BLOCK).cast("int"), F.ceil(F.col("outside") / BLOCK).cast("int")
    i, j = F.pmod(F.xxhash64("vid", F.lit(1)), F.col("_down")).cast("int"), F.pmod(F.xxhash64("vid"), F.col("_across")).cast("int")
    cell = lambda i, j, probe, target: F.struct(i.alias("i"), j.alias("j"), probe.alias("probe"), target.alias("target"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    as_target = F.transform(F.sequence(zero, F.col("_down") - 1), lambda x: cell(x, j, no, yes))
    as_probe = F.when(probe, F.transform(F.sequence(zero, F.col("_across") - 1), lambda x: cell(i, x, yes, no))).otherwise(F.array().cast("array<struct<i int, j int, probe boolean, target boolean>>"))
    cells = F.when(F.col("many") <= BLOCK, F.array(cell(zero, zero, probe, yes))).otherwise(F.concat(as_target, as_probe))
    out = split.withColumn("_across", across).withColumn("_down", down).withColumn("_cell", F.explode(cells))
    return out.select("key", "_cell.*", *(c for c in split.columns if c not in ("key", "top", "many", "outside"))).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def proposals(split: DataFrame, rule: Rule) -> DataFrame:
    """(key, vid, partner, apart): each row that has an allowed partner in its group, or is one; a probe with the partner that is
    nearest by bitmap, others with null."""
    schema = schema_of("key long, vid long, partner long, apart long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs_of(batches):
            key, vid, probe = (table.column(k).to_numpy() for k in ("key", "vid", "probe"))
            a, b, apart = small_pairs(table, starts, rule)
            near, met = [(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([apart, apart]))], [a, b]
            for at, to in zip(starts[:-1], starts[1:], strict=True):
                if to - at > SMALL:
                    for p, q, d in Group(table, at, to).pairs(rule):
                        first = firsts(p, q, d)
                        near.append((p[first] + at, q[first] + at, d[first]))
                        met += [np.unique(p) + at, np.unique(q) + at]
            p, q, d = (np.concatenate(x) for x in zip(*near, strict=True))
            p, q, d = p[mine := probe[p]], q[mine], d[mine]
            first = firsts(p, q, d)
            rows = np.setdiff1d(np.concatenate(met), p)
            partner = pa.concat_arrays([pa.array(vid[q[first]]), pa.nulls(len(rows), pa.int64())])
            apart = pa.concat_arrays([pa.array(d[first]), pa.nulls(len(rows), pa.int64())])
            rows = np.concatenate([p[first], rows])
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(vid[rows]), partner, apart], names=schema.names)

    return dealt(split).mapInArrow(run, schema)


def firsts(p: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of each p's least (d, q)."""
    order = np.lexsort((q, d, p))
    return order[np.concatenate([[True], p[order][1:] != p[order][:-1]])] if len(order) else order


def links_within(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links between components of a group, found exactly where the rows (with elements) stand; a task gives
    those between what it hasn't linked yet, fewer than its rows."""
    schema = schema_of("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs_of(batches):
            for at, to in zip(starts[:-1], starts[1:], strict=True):
                g = Group(table, at, to)
                elements = g.part.column("elements")
                up: dict[int, int] = {}

                def root(c: int, up=up) -> int:
                    while (p := up.get(c, c)) != c:
                        up[c] = c = up.get(p, p)
                    return c

                found = []
                for p, q, _ in g.pairs(rule):
                    for x, y in zip(p.tolist(), q.tolist(), strict=True):
                        c, d = root(int(g.comp[x])), root(int(g.comp[y]))
                        if c != d and linked(elements[x].as_buffer(), elements[y].as_buffer(), rule):
                            up[max(c, d)] = min(c, d)
                            found.append((int(g.vid[x]), int(g.vid[y])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=schema.names)

    return dealt(rows).mapInArrow(run, schema)


def still_split(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, vid) of ``met`` in groups of several components (labels: vid, comp), with comp and the group's top, many, outside."""
    by_key = met.join(labels, "vid", "left").select("vid", "key", F.coalesce("comp", "vid").alias("comp"))
    each = by_key.groupBy("key", "comp").agg(F.count("*").alias("n"))
    groups = each.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("many")).where("top.n < many")
    groups = stored(groups.select("key", "top.comp", "many", (F.col("many") - F.col("top.n")).alias("outside")).withColumnRenamed("comp", "top"), "jaccard-groups")
    # a group's rows are many, its line in ``groups`` one: Spark splits such a join where a key is hot
    return stored(by_key.join(groups, "key"), "jaccard-split")


def finer_keys(s: np.ndarray, bands: np.ndarray, apart: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tile, room, keys) in the tiles of the set's band and of the band before: 2 D + 2 parts, empty ones too.

    A pair that links differs in D parts at most, so it has D + 2 in common. However the keys are ordered, each set's last D + 1 can't
    be all of these: a common one is among the first room = D + 1 of both.
    """
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * np.uint64(0x94D049BB133111EB) ^ (s >> np.uint64(31)), dtype=np.uint64)])
    band = int(np.searchsorted(bands, len(s), side="right")) - 1
    for tile in range(max(0, band - 1), band + 1):
        room = int(apart[tile]) + 1
        k = 2 * room
        at = np.concatenate([np.searchsorted(s, np.arange(k, dtype=np.uint64) * np.uint64((1 << 64) // k)), [len(s)]])
        keys = mixed(sums[at[1:]] - sums[at[:-1]], np.diff(at).astype(np.uint64), np.arange(k, dtype=np.uint64), np.full(k, tile, np.uint64), np.full(k, 2, np.uint64))
        yield tile, room, keys.view(np.int64)


def finer(split: DataFrame, sets: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """``split`` (see still_split) with the sets of groups beyond SPLIT_BLOCKS blocks in groups of equal smaller parts, each set by its rarest."""
    large = F.col("many") > SPLIT_BLOCKS * BLOCK
    hot = stored(split.where(large).select("vid").distinct(), "jaccard-hot")
    if hot.isEmpty():
        return split
    schema = schema_of("vid long, tile int, room int, keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, apart = rule.bands(), rule.parts()[1]
        for batch in batches:
            vids, elements = batch.column("vid").to_pylist(), batch.column("elements")
            rows = [(v, *x) for v, e in zip(vids, elements, strict=True) for x in finer_keys(np.frombuffer(e.as_buffer(), np.uint64), bands, apart)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f) for i, f in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=schema.names)

    each = of_ids(sets, hot).select("vid", "elements").mapInArrow(run, schema).select("vid", "tile", "room", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("vid", "tile")
    # keys that no other set has come first: the shared ones have what room these leave
    ranked = each.join(shared, "key").withColumn("place", F.row_number().over(own.orderBy("n", "key"))).withColumn("several", F.count("*").over(own))
    met = ranked.where(F.col("place") + 2 * F.col("room") - F.col("several") <= F.col("room")).select("vid", "key")
    return split.where(~large).unionByName(still_split(met, labels))


def linked_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key, n_shingles, vid and comp (a vid) of each row of ``docs``; comp is null where nothing links with the set."""
    rows = stored(described(docs, rule, shared_parts(docs, rule)), "jaccard-rows")
    each = once_each(rows).withColumnRenamed("n_shingles", "size")
    marks, sets = each.select("vid", "size", "bitmap"), each.select("vid", "elements")
    met = each.select("vid", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    # long texts that are much alike share many parts: of the groups with the same sets (told by two hashes over them) one is enough
    sign = [F.bit_xor(F.xxhash64("vid", F.lit(k))).alias(f"sign{k}") for k in (1, 2)]
    groups = met.groupBy("key").agg(F.max(F.struct("n", "vid")).alias("hub"), F.count("*").alias("many"), *sign).where("many > 1")
    hubs = stored(groups.groupBy("many", "sign1", "sign2").agg(F.min(F.struct("key", "hub")).alias("g")).select("g.*"), "jaccard-hubs")
    met = stored(met.join(hubs, "key").select("vid", "key", "hub"), "jaccard-met")

    star = met.where("hub.vid <> vid").groupBy("vid").agg(F.max("hub").alias("hub")).select(F.col("vid").alias("a"), F.col("hub.vid").alias("b"))
    links = stored(checked(allowed(star, marks, rule), sets, rule), "jaccard-links")
    labels = components(links)
    split = finer(still_split(met, labels), sets, labels, rule)
    while not split.isEmpty():
        near = stored(proposals(split.join(of_ids(marks, split.select("vid").distinct()), "vid"), rule), "jaccard-near")
        if near.isEmpty():
            break
        best = near.where("partner is not null").groupBy("vid").agg(F.min(F.struct("apart", "partner")).alias("best")).select(F.col("vid").alias("a"), F.col("best.partner").alias("b"))
        found = stored(checked(best, sets, rule), "jaccard-links")
        last = found.isEmpty()
        if last:  # what the nearest partners didn't give may be with the others
            rows_left = stored(split.join(near.select("key", "vid"), ["key", "vid"], "left_semi"), "jaccard-open")
            whole = of_ids(each.select("vid", "size", "bitmap", "elements"), rows_left.select("vid").distinct())
            found = stored(links_within(rows_left.join(whole, "vid"), rule), "jaccard-links")
        if last and found.isEmpty():
            break
        links = links.union(found)
        labels = components(links)
        if last:
            break
        # components only grow, so what had no allowed partner in its group won't get one; a row is told by each rectangle
        split = still_split(near.select("vid", "key").distinct(), labels)
    return rows.select("doc_id", "text_key", "n_shingles", "vid").join(labels, "vid", "left")


def query(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id in its component) of each document."""
    with temporary(docs.sparkSession):
        rows = linked_components(docs, rule)
        named = stored(rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "vid")).alias("comp")), "jaccard-named", last=True)
        # a component may have a third of all rows: its smallest id is a partial aggregate, stored, so that Spark splits the join back
        names = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1")
        names = stored(names.select("comp", "least"), "jaccard-names", last=True)
    return named.join(names, "comp", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents without those that link, directly or over others, with one that comes first.

    Of a component one row stays: that of the smallest id (a null id counts as larger than any other), of rows equal
    in id that of the smallest set, then of the smallest hash of its text; of rows equal in id and text, one.
    Documents without words all stay. Rows are known by id and a 64-bit hash of the text, so rows that share an id,
    or have none, fare each by its own text.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "vid", "text_key")
    with temporary(docs.sparkSession):
        rows = linked_components(docs.select("doc_id", "text"), rule).where("n_shingles > 0").withColumn("comp", F.coalesce("comp", "vid"))
        rows = stored(rows, "jaccard-named")
        least = stored(rows.groupBy("comp").agg(F.min(place).alias("_least"), F.count("*").alias("_many")).where("_many > 1").select("comp", "_least"), "jaccard-names")
        fate = rows.join(least, "comp").groupBy("doc_id", "text_key").agg(F.max(place > F.col("_least")).alias("drop"), F.count("*").alias("many"))
        # a row that is dropped, or stays as one of several equal ones: the others of ``docs`` aren't in it
        fate = stored(fate.where("drop or many > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("drop").alias("_drop")), "jaccard-fate", last=True)
    packed = docs.select(F.col("doc_id").alias("_order"), F.xxhash64("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    same = F.col("_order").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    kept, twice = packed.join(fate.where("_drop"), same, "left_anti"), fate.where("not _drop")
    if twice.isEmpty():
        return kept.select("_row.*")
    once = kept.join(twice, same, "left_semi").dropDuplicates(["_order", "_text"])
    return kept.join(twice, same, "left_anti").unionByName(once).select("_row.*")
