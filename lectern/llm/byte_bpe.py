"""Byte-level BPE by monoid tree reduction, and decoding up the same tree.

A token sequence is an element of a monoid: ``join`` of the encodings of two byte strings is the encoding of
their concatenation. A piece (one match of the split pattern) is encoded by halves, and two neighbours are
joined by encoding a window around their border anew, which grows on the sides where it isn't stable yet.

When is it stable? By ranks, the encoding of a string is t1..tn exactly if every adjacent pair stays apart,
that is if encoding the bytes of ti ti+1 gives (ti, ti+1) again: the first merge across a border in the whole
would be the first across it in the pair as well, for a pair sees the same merges in the same order. Tokens
inside either side and inside the window are encodings already, so only the window's two outer borders need
the test, and once both hold, the tokens outside provably are what the whole encoding has.

The tree's leaves are strings of up to LEAF bytes, merged by rank in one loop. Pieces recur, and still more so their
halves and the windows, so a worker keeps the encodings of short ones: two generations of bounded size, the older of
which goes when the younger is full.

Defined cases: a null or empty text has no tokens; texts are encoded whole, whatever their length; repeated
rows alike, each by itself. Special tokens are never made: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable
from itertools import chain
from operator import itemgetter

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_rows, schema_of

#: Bytes of a leaf of the tree; longest window (in bytes) and piece (in characters) that are kept.
LEAF = 8
KEPT_BYTES, KEPT_CHARS = 12, 48
#: Pieces, byte strings, and pairs of tokens, of a generation.
KEPT_PIECES, KEPT_PARTS, KEPT_PAIRS = 400_000, 200_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file: lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Kept(dict):
    """Values made by ``make`` for their keys, of which the latest used are held: up to twice ``most``."""

    def __init__(self, make: Callable, most: int, short: Callable = lambda key: True) -> None:
        self.make, self.most, self.short, self.older = make, most, short, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if not self.short(key):
                return got
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


def ids_of(pieces: list[tuple[tuple[int, ...], str]]) -> list[int]:
    return list(chain.from_iterable(map(itemgetter(0), pieces)))


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.apart = Kept(self._stays_apart, KEPT_PAIRS)
        #: piece -> its ids, and the same as text
        self.pieces = Kept(self._piece, KEPT_PIECES, lambda p: len(p) <= KEPT_CHARS)
        self.parts = Kept(self._few, KEPT_PARTS)

    def merged(self, data: bytes) -> list[int]:
        """Encoding by lowest rank first, leftmost of equals, without the tree: for leaves and windows."""
        if len(data) <= KEPT_BYTES:
            return self.parts[data]
        return self._few(data) if len(data) <= 32 else self._many(data)

    def _few(self, data: bytes) -> list[int]:
        """By looking at the least of all pairs each time."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        offers = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while offers and (best := min(offers)) != none:
            i = offers.index(best)
            new = parts[i] = parts[i] + parts.pop(i + 1)
            del offers[i]
            if i:
                offers[i - 1] = rank(parts[i - 1] + new, none)
            if i < len(offers):
                offers[i] = rank(new + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _many(self, data: bytes) -> list[int]:
        """By a heap over a linked list, for windows of any size."""
        n, ranks = len(data), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (r := ranks.get(data[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if ends[i] < 0 or (j := ends[i]) >= n or ends[j] != e:
                continue  # one of the two has changed since
            ends[i], ends[j] = e, -1
            if e < n:
                before[e] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def _stays_apart(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def stays_apart(self, a: int, b: int) -> bool:
        return self.apart[a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two sides' bytes together."""
        if not left or not right:
            return left + right
        if self.stays_apart(left[-1], right[0]):
            return left + right
        i, j, grow_i, grow_j = 1, 1, 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(self.decode(left[len(left) - i :]) + self.decode(right[:j]))
            left_holds = i == len(left) or self.stays_apart(left[-i - 1], window[0])
            right_holds = j == len(right) or self.stays_apart(window[-1], right[j])
            if left_holds and right_holds:
                return left[: len(left) - i] + window + right[j:]
            if not left_holds:
                i, grow_i = i + grow_i, 2 * grow_i
            if not right_holds:
                j, grow_j = j + grow_j, 2 * grow_j

    def encode_bytes(self, data: bytes) -> list[int]:
        """The encoding of a piece, by halves."""
        if len(data) <= LEAF:
            return self.parts[data]
        mid = len(data) // 2
        return self.join(self.encode_bytes(data[:mid]), self.encode_bytes(data[mid:]))

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = tuple(self.encode_bytes(data)) if whole is None else (whole,)
        return ids, ",".join(map(str, ids))

    def encoded_pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        return list(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return ids_of(self.encoded_pieces(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_tree(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined pairwise up the tree."""
        parts = [self.decode(ids[i : i + 256]) for i in range(0, len(ids), 256)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


_HELD: dict[int, Encoder] = {}


def sent(spark: SparkSession, path: str, pattern: str):
    """The rank file's contents and the pattern, for all executors (the driver reads the file; its size is the vocabulary's)."""
    return spark.sparkContext.broadcast((read_ranks(path), pattern))


def encoder_of(variable) -> Encoder:
    """One encoder a worker, whose cache lasts over tasks."""
    if id(variable) not in _HELD:
        _HELD.clear()
        _HELD[id(variable)] = Encoder(*variable.value)
    return _HELD[id(variable)]


def encode_documents(docs: DataFrame, path: str, pattern: str, keys: list[str]) -> DataFrame:
    """``keys`` and ids (array) of each document."""
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    ranks = sent(docs.sparkSession, path, pattern)

    def run(cols: dict[str, list]) -> dict[str, list]:
        e = encoder_of(ranks)
        return {k: cols[k] for k in keys} | {"ids": [e.encode(t or "") for t in cols["text"]]}

    return map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema, binary=())


def decode_documents(encoded: DataFrame, path: str, pattern: str, keys: list[str]) -> DataFrame:
    """``keys`` and text of each row of ids; bytes that aren't UTF-8 become U+FFFD. Null ids give a null text."""
    schema = T.StructType([*(encoded.schema[k] for k in keys), T.StructField("text", T.StringType())])
    ranks = sent(encoded.sparkSession, path, pattern)

    def run(cols: dict[str, list]) -> dict[str, list]:
        e = encoder_of(ranks)
        return {k: cols[k] for k in keys} | {"text": [None if x is None else e.decode_tree(x).decode("utf-8", "replace") for x in cols["ids"]]}

    return map_rows(encoded.select(*dict.fromkeys([*keys, "ids"])), run, schema, binary=())


def digests(docs: DataFrame, path: str, pattern: str, ids_too: bool = False, keys: list[str] | None = None) -> DataFrame:
    """One row for each document: number of tokens, digests of the ids and of the bytes decoded from them; and the ids, if asked for, and ``keys``."""
    keys = keys or []
    schema = T.StructType([docs.schema["doc_id"], *schema_of("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    if ids_too:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*schema.fields, *(docs.schema[k] for k in keys)])
    ranks = sent(docs.sparkSession, path, pattern)

    def run(cols: dict[str, list]) -> dict[str, list]:
        e = encoder_of(ranks)
        out: dict[str, list] = {f.name: [] for f in schema} | {k: cols[k] for k in ["doc_id", *keys]}
        for t in cols["text"]:
            pieces = e.encoded_pieces(t or "")
            ids = ids_of(pieces)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(itemgetter(1), pieces)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(e.decode_tree(ids)).hexdigest())
            if ids_too:
                out["ids"].append(ids)
        return out

    return map_rows(docs.select("doc_id", "text", *keys), run, schema, binary=())


def encoded(docs: DataFrame, path: str, pattern: str, keys: list[str] | None = None) -> DataFrame:
    """digests() with the ids, and ``keys``."""
    return digests(docs, path, pattern, ids_too=True, keys=keys)
