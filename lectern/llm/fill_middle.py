"""Fill-in-the-middle transformation by a piece table.

A document is a list of descriptors (buffer, start, end) over two immutable buffers, its UTF-8 bytes and the sentinels.
Cutting splits a descriptor at a byte; an arrangement is a permutation of the three parts with a sentinel's descriptor
before each; bytes are only copied when an output is written, and hashes are fed with the descriptors' views. The way
back cuts the output at its sentinels, which the text doesn't contain, and permutes by the inverse.

Units are lines with their ends. A document stays plain where its text is empty or contains a sentinel, or its hash
exceeds the rate. Sentinels can't arise at a border: each has its only "<" at its front and its only ">" at its end.

Defined cases: null text: empty; null id: the hash of the seed alone; empty parts are descriptors of length 0; equal rows
give equal results; extra columns go along in ``transform``, those with clashing names stay as they are under their
own, the new ones in a struct; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import schema_of, sized_slices

#: Front marks of prefix, suffix and middle.
SENTINELS = (b"<P>", b"<S>", b"<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: Parts in the order of the output, as places in the text (0 prefix, 1 middle, 2 suffix), and each part's sentinel.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARK = (0, 2, 1)

TEXT, MARKS = 0, 1
MARK_BUFFER = b"".join(SENTINELS)
MARK_AT = [(MARKS, 3 * i, 3 * i + 3) for i in range(3)]

Piece = tuple[int, int, int]


class Pieces:
    """Descriptors over the buffers; every change is a new list over the same bytes."""

    def __init__(self, text: bytes, pieces: list[Piece] | None = None) -> None:
        self.text = text
        self.buffers = (memoryview(text), memoryview(MARK_BUFFER))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *at: int) -> Pieces:
        """Split at bytes of the content, in rising order; a cut at an end makes an empty piece there."""
        out, done, left = [], 0, list(at)
        for b, s, e in self.pieces:
            while left and left[0] <= done + e - s:
                to = s + left.pop(0) - done
                out.append((b, s, to))
                done, s = done + out[-1][2] - out[-1][1], to
            out.append((b, s, e))
            done += e - s
        return Pieces(self.text, out)

    def permuted(self, order: tuple[int, ...]) -> Pieces:
        return Pieces(self.text, [self.pieces[i] for i in order])

    def marked(self, marks: list[int]) -> Pieces:
        """Each piece after its sentinel."""
        return Pieces(self.text, [p for m, piece in zip(marks, self.pieces, strict=True) for p in (MARK_AT[m], piece)])

    def unmarked(self) -> Pieces:
        return Pieces(self.text, [p for p in self.pieces if p[0] == TEXT])

    def views(self) -> Iterator[memoryview]:
        for b, s, e in self.pieces:
            yield self.buffers[b][s:e]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for v in self.views():
            h.update(v)
        return h.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.views())


def draws(doc_id: int | None, seed: int) -> list[int]:
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(d[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: bytes, doc_id: int | None, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple[Pieces, str, int, Pieces | None]:
    """Output, form, number of lines and the three parts (None: plain)."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
    whole = Pieces(text)
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return whole, "plain", n, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: int(ends[k - 1]) if k else 0
    parts, form = whole.cut(place(first), place(last)), "spm" if h4 % 100 < spm_rate else "psm"
    order = ARRANGEMENTS[form]
    return parts.permuted(order).marked([MARK[i] for i in order]), form, n, parts


def restored(output: bytes, form: str) -> Pieces:
    """The text's pieces, from the output and its form alone."""
    if form == "plain":
        return Pieces(output)
    order, at, pieces = ARRANGEMENTS[form], 0, []
    for k, part in enumerate(order):
        mark = SENTINELS[MARK[part]]
        if output[at : at + 3] != mark:
            raise ValueError(f"no {mark.decode()} at byte {at}")
        to = len(output) if k == 2 else output.find(SENTINELS[MARK[order[k + 1]]], at + 3)
        if to < 0:
            raise ValueError("a sentinel is missing")
        pieces.append((TEXT, at + 3, to))
        at = to
    back = tuple(order.index(i) for i in range(3))
    return Pieces(output, pieces).permuted(back)


def points(view: memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return int((np.frombuffer(view, np.uint8) & 0xC0 != 0x80).sum()) if len(view) else 0


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """All columns, and fim: a struct of form, n (lines) and output (text)."""
    name = "fim" if "fim" not in docs.columns else "_fim"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, schema_of("form string, n long, output string"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sized_slices(batches):
            out = []
            for t, i in zip(texts, part.column("doc_id").to_pylist(), strict=True):
                pieces, form, n, _ = arranged(t or b"", i, rate, spm_rate, seed)
                out.append({"form": form, "n": n, "output": pieces.content().decode()})
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.struct([("form", pa.string()), ("n", pa.int64()), ("output", pa.string())]))], names=schema.names)

    return docs.mapInArrow(run, schema)


def restore(df: DataFrame) -> DataFrame:
    """text of rows (form, output), with the other columns of ``df``."""
    keep = [c for c in df.columns if c not in ("form", "output", "text")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, outputs in sized_slices(batches, "output"):
            texts = [restored(o or b"", f).content().decode() for o, f in zip(outputs, part.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each document."""
    schema = T.StructType([docs.schema["doc_id"], *schema_of("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string").fields])

    def row(t: bytes | None, doc_id: int | None) -> tuple:
        pieces, form, n, parts = arranged(t or b"", doc_id)
        prefix, middle = (None, None) if parts is None else map(points, list(parts.views())[:2])
        return n, form, prefix, middle, pieces.sha256(), restored(pieces.content(), form).sha256()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sized_slices(batches):
            cols = list(zip(*map(row, texts, part.column("doc_id").to_pylist()), strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
