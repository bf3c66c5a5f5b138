"""Periodic runs of words (maximal repetitions) by descending-LCP Kruskal over suffix classes.

A run is a stretch with smallest period q and a length of max(least, 2 q) or more that can't be extended. The suffixes
of a document's words are sorted by prefix doubling, whose ranks also give the common prefixes (LCP) of neighbours. The
pairs of neighbours are taken by falling LCP and their classes united; each class keeps its positions in order, and the
smaller one's are put into the larger one's. Positions i < j that become neighbours in a class have exactly the LCP at
hand, L: if j - i <= L, the stretch from i to j + L has period j - i, can't be extended to the right, and has no smaller
period, as a position between them would have joined i before. It is a run if it can't be extended to the left either.
Every run is found so at its first position, once.

A run of ``least`` words or more repeats least / 2 words within its document, so unions stop at that LCP, and
documents without such a repeat (told by one sort of hashes of stretches) have no runs and need no suffixes.

Defined cases: no text or no words: no runs; a null id: the text as it is (see ``planted``); very long texts: about 100
bytes a word in one task; equal rows give equal results; extra columns don't matter; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import schema_of, sized_slices

#: Words of a run at least.
LEAST = 12


class Ordered:
    """A set of numbers in order, in pieces, so that putting one in moves a piece at most."""

    PIECE = 512

    def __init__(self, first: int) -> None:
        self.pieces, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for p in self.pieces:
            yield from p

    def put(self, x: int) -> tuple[int, int]:
        """Puts ``x`` in; the neighbours before and after it, -1 where there is none."""
        self.size += 1
        k = bisect_left(self.tops, x)
        if k == len(self.pieces):
            piece = self.pieces[-1]
            before = piece[-1]
            piece.append(x)
            self.tops[-1] = x
            k, after = k - 1, -1
        else:
            piece = self.pieces[k]
            at = bisect_left(piece, x)
            before = piece[at - 1] if at else self.tops[k - 1] if k else -1
            after = piece[at]
            piece.insert(at, x)
        if len(piece) > 2 * self.PIECE:
            self.pieces[k : k + 1] = [piece[: self.PIECE], piece[self.PIECE :]]
            self.tops[k : k + 1] = [piece[self.PIECE - 1], piece[-1]]
        return before, after


def repeats(ids: np.ndarray, length: int) -> bool:
    """May a stretch of this length occur twice? (Equal stretches have equal hashes.)"""
    n = len(ids) - length + 1
    if n < 2:
        return False
    h = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64)
    for i in range(length):
        h = (h ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the LCP of each with the one before (0 for the first)."""
    n = len(ids)
    levels = [ids.astype(np.int64)]  # ranks by the first 1, 2, 4 ... words; a suffix that ends before differs from all
    step = 1
    while step < n:
        key = (levels[-1] + 1) * (n + 2)
        key[:-step] += levels[-1][step:] + 1
        distinct, rank = np.unique(key, return_inverse=True)
        levels.append(rank)
        if len(distinct) == n:
            break
        step *= 2
    order = np.argsort(levels[-1]) if n > 1 else np.zeros(1, np.int64)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = np.concatenate([levels[k], [-1]])  # -1: past the end
        ra, rb = rank[np.minimum(a, n)], rank[np.minimum(b, n)]
        same = np.flatnonzero((ra == rb) & (ra >= 0))
        for x in (a, b, lcp):
            x[same] += 1 << k
    return order, np.concatenate([[0], lcp])


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ids: a number a word, below the number of words."""
    floor = max(1, least // 2)
    if not repeats(ids, floor):
        return []
    order, lcp = suffixes(ids, least)
    pairs = np.flatnonzero(lcp >= floor)
    pairs = pairs[np.argsort(-lcp[pairs], kind="stable")]
    up, sets, found = {}, {}, []
    words = ids.tolist()

    def root(p: int) -> int:
        while (q := up.get(p, p)) != p:
            up[p] = p = up.get(q, q)
        return p

    for x, y, common in zip(order[pairs - 1].tolist(), order[pairs].tolist(), lcp[pairs].tolist(), strict=True):
        x, y = root(x), root(y)
        large, small = sets.pop(x, None) or Ordered(x), sets.pop(y, None) or Ordered(y)
        if large.size < small.size:
            large, small, x, y = small, large, y, x
        up[y], sets[x] = x, large
        last, following = -1, iter(small)
        next(following)
        for p in small:
            before, after = large.put(p)
            # what lies between two of the smaller class was beside them already, or is put in next
            ahead = next(following, None)
            for i, j in ((before, p) if before != last else (-1, p), (p, after) if ahead is None or after < ahead else (p, -1)):
                if 0 <= i < j and j - i <= common and j - i + common >= least and (i == 0 or words[i - 1] != words[j - 1]):
                    found.append((i, j - i + common, j - i))
            last = p
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is brought down to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repeat that the id asks for (of one id in ten, from some place to the end)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def found_runs(docs: DataFrame, keep: list[str], least: int = LEAST) -> DataFrame:
    """The columns ``keep``, runs (structs of start, length, period, all counted in words) and collapsed (the words that stay)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *schema_of("runs array<struct<start: long, length: long, period: long>>, collapsed string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sized_slices(batches):
            runs, out = [], []
            for t in texts:
                w = (t or b"").split()
                r = runs_of(numbered(w), least)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in r])
                out.append(b" ".join(w if not r else [w[i] for i in np.flatnonzero(kept(len(w), r))]).decode())
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(runs, kind), pa.array(out, pa.string())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The longest run, the number of runs and digests of each document, after ``planted``."""
    schema = T.StructType([docs.schema["doc_id"], *schema_of("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string").fields])

    def row(t: bytes | None, doc_id: int | None) -> tuple:
        w = planted((t or b"").split(), doc_id)
        runs = runs_of(numbered(w))
        left = w if not runs else [w[i] for i in np.flatnonzero(kept(len(w), runs)).tolist()]
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        return len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sized_slices(batches):
            cols = list(zip(*map(row, texts, part.column("doc_id").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.string() if f.name.endswith("sha256") else pa.int64()) for c, f in zip(cols, schema.fields[1:], strict=True))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
