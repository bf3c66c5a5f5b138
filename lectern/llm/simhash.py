"""SimHash near-duplicates by covering locality-sensitive hashing: every pair within the radius meets in some table.

A text's fingerprint has bit i if over half of its shingles' hashes have it. Bit positions are dealt to the nonzero
vectors of radius + 1 bits; the table of a nonzero vector v keeps the bits whose vector has an odd product with v. The
vectors of any ``radius`` positions leave some v that is orthogonal to all of them, so two fingerprints that differ
there at most agree on all that this v's table keeps: for radius 2 seven tables of about 36 bits (the complements of
the Fano plane's lines). Nothing is missed, and what meets is checked by counting bits.

The vertices are distinct fingerprints, counted in a partial aggregate, so copies, however many, are one. A bucket of a
table up to BLOCK fingerprints is compared where it stands, and gives a forest: fewer links than it has rows. Larger
buckets aren't compared in pairs at all: two fingerprints are within two bits if and only if they have a common
neighbour within one, so each is written to its neighbours among the bits that the table leaves out (about 28), and
those at one neighbour, never more than these bits and 1, are linked in a chain. (Radius 1: to itself without each bit.)

Defined cases: no words or no text: fingerprint zero, which links like any other; fewer words than n: the whole sequence
is the one shingle; equal rows share a vertex, each gives a row; a null id takes part, but names a component only where
all its ids are null; empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import schema_of, sized_slices, stored, temporary
from .components import components
from .jaccard_join import sent_if_few

BITS = 64
#: Words of a shingle, bits in which linked fingerprints differ at most, and the hash's seed.
SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of a bucket that are compared with each other; larger buckets go by common neighbours.
BLOCK = 1_024


def tables(radius: int = RADIUS) -> list[int]:
    """Bits that each table keeps, as a number."""
    vectors = range(1, 2 << radius)
    place = [vectors[i % len(vectors)] for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (place[i] & v).bit_count() & 1) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of each run of n words, repeats included."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    shingles = [b" ".join(w)] if len(w) < n else map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))
    one = xxhash.xxh64_intdigest
    return np.array([one(s, SEED) for s in shingles], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number; 0 of none."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at : at + (1 << 13)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return signed(int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little"))


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sized_slices(batches):
            fps = [fingerprint(shingle_hashes(t or b"", n)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius, fewer than the fingerprints."""
    up = list(range(len(fps)))

    def root(a: int) -> int:
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    out = []
    for i in range(len(fps) - 1):
        for j in (i + 1 + np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= radius)).tolist():
            a, b = root(i), root(j)
            if a != b:
                up[b] = a
                out.append((i, j))
    return out


def links_of_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows (tab, key, fp) of buckets up to BLOCK rows: a forest of each bucket's links."""
    schema = schema_of("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            fps, a, b = table.column("fp").to_numpy().view(np.uint64), [], []
            size = np.diff(starts)
            two = starts[:-1][size == 2]  # most buckets
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            for at, to in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist(), strict=True):
                for i, j in forest(fps[at:to], radius):
                    a.append(at + i)
                    b.append(at + j)
            x, y = (np.concatenate([np.array(p, np.int64), q]) for p, q in ((a, two), (b, two + 1)))
            return pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)), pa.array(fps[y].view(np.int64))], names=schema.names)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            tab, key = table.column("tab").to_numpy(), table.column("key").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])[: len(key)])
            if len(starts) > 1:
                yield linked(table.slice(0, starts[-1]), starts)
                held = table.slice(starts[-1]).to_batches()
        if held and sum(map(len, held)):
            table = pa.Table.from_batches(held).combine_chunks()
            yield linked(table, np.array([0, table.num_rows]))

    return rows.repartition("tab", "key").sortWithinPartitions("tab", "key").mapInArrow(run, schema)


def neighbours(fp: Column, omitted: Column, radius: int) -> Column:
    """What fingerprints within the radius have in common, within the omitted bits (an array of numbers with one bit)."""
    if radius == 1:
        return F.transform(omitted, lambda b: F.struct(b.alias("bit"), fp.bitwiseAND(F.bitwise_not(b)).alias("z")))
    return F.transform(F.concat(F.array(F.lit(0).cast("long")), omitted), lambda b: F.struct(F.lit(0).cast("long").alias("bit"), fp.bitwiseXOR(b).alias("z")))


def links_by_neighbours(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows (tab, key, fp) of buckets of any size: those at a common neighbour, each with the least."""
    bits = [[signed(1 << i) for i in range(BITS) if not mask >> i & 1] for mask in tables(radius)]
    omitted = F.element_at(F.array(*(F.array(*(F.lit(b).cast("long") for b in each)) for each in bits)), F.col("tab") + 1)
    at = rows.select("tab", "fp", F.explode(neighbours(F.col("fp"), omitted, radius)).alias("c")).select("tab", "fp", "c.*")
    # a neighbour has as many fingerprints around it as the table omits bits, and itself
    met = at.groupBy("tab", "bit", "z").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1").select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return met.where("a <> b").distinct()


def linked_components(vertices: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(vid, comp) of the distinct fingerprints (fp) that link with another; comp is the component's least fingerprint."""
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2")
    masks = F.array(*(F.struct(F.lit(t).alias("tab"), F.lit(signed(m)).cast("long").alias("mask")) for t, m in enumerate(tables(radius))))
    rows = vertices.select("fp", F.explode(masks).alias("t")).select("fp", "t.tab", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    buckets = rows.groupBy("tab", "key").agg(F.count("*").alias("many")).where("many > 1")
    rows = stored(rows.join(buckets, ["tab", "key"]), "simhash-buckets")
    links = links_of_buckets(rows.where(F.col("many") <= BLOCK), radius)
    large = rows.where(F.col("many") > BLOCK)
    if not large.isEmpty():
        links = links.union(links_by_neighbours(large, radius))
    return components(links)


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, class_size (documents of the component) and component_id (its smallest id) of each row."""
    with temporary(docs.sparkSession):
        prints = stored(fingerprints(docs, n), "simhash-prints", last=True)
        vertices = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")), "simhash-vertices")
        labels = linked_components(vertices.select("fp"), radius)
        named = vertices.join(labels.withColumnRenamed("vid", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        names = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("many").alias("class_size")).where("class_size > 1")
        found = stored(named.select("fp", "comp").join(names, "comp").select("fp", "component_id", "class_size"), "simhash-classes", last=True)
    return prints.join(sent_if_few(found), "fp", "left").select("doc_id", "fp", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and class_size of each document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")
