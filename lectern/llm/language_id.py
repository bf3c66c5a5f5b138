"""Language identification by compression: the language whose dictionary makes the text smallest.

For each language a raw-content zstandard dictionary is made of labelled text. A text is compressed in
pieces against every dictionary (pieces, so that a long text doesn't become its own dictionary; together
they are the whole text), and the sizes are added up. The score is the margin of the smallest over the
second, scaled to 0..1; below MARGIN the row is marked as rejected (``rejected``), its best guess stays.

Defined cases: null, empty or letterless text: ``und``, score 0, rejected; ties go to the language that is
first in order; repeated rows alike, each by itself; without any labelled text all rows are ``und``.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, schema_of

#: Bytes of labelled text in a language's dictionary, and rows it comes from, at most.
DICTIONARY_BYTES = 96_000
DICTIONARY_ROWS = 200
#: Languages that can be learned; more than that is an error, not a silent cut.
MAX_LANGUAGES = 500
#: Bytes compressed at a time.
PIECE = 4_096
LEVEL = 6
#: Least difference between the two smallest sizes, as a share of the smallest.
MARGIN = 0.01
#: Margin from which the score is 1.
SURE = 0.25
UNKNOWN = "und"

_LETTERS = bytes(i if i >= 128 or chr(i).islower() else 32 for i in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def dictionaries(docs: DataFrame, learn: Column) -> list[tuple[str, bytes]]:
    """(lang, content) from the rows where ``learn``, languages in order.

    Each language's distinct texts are counted first; then texts whose hash falls under a threshold made from the
    count (about four times DICTIONARY_ROWS) are ranked by it, so that a language with most rows isn't gathered
    anywhere, and copies of a text count as one. A chosen text gives one stretch of its text, from a place that its hash names.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text")
    texts = rows.select("lang", F.xxhash64("text").alias("_h")).distinct()
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    share = DICTIONARY_BYTES // DICTIONARY_ROWS
    below = F.create_map(*(F.lit(v) for x, n in counts.items() for v in (x, min(1.0, 4 * DICTIONARY_ROWS / n))))
    hashed = rows.withColumn("_h", F.xxhash64("text")).where(F.pmod(F.col("_h"), F.lit(1_000_003)) / 1_000_003 < below[F.col("lang")])
    start = F.pmod(F.col("_h"), F.greatest(F.length("text") - share, F.lit(1))).cast("int") + 1
    parts = hashed.select("lang", "_h", F.substring(F.col("text"), start, F.lit(share)).alias("part")).dropDuplicates(["lang", "_h"])
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= DICTIONARY_ROWS)
    got: dict[str, list[str]] = {x: [] for x in counts}
    for r in ranked.orderBy("lang", "_r").select("lang", "part").collect():
        got[r.lang].append(r.part)
    return [(x, plain(" ".join(parts))[:DICTIONARY_BYTES]) for x, parts in got.items()]


def plain(text: str) -> bytes:
    """Lower case, with ASCII other than letters as spaces: marks and digits say nothing about a language."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS)


class Classifier:
    def __init__(self, content: list[tuple[str, bytes]]) -> None:
        self.langs = [x for x, _ in content]
        self.compress = []
        for _, data in content:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return [sum(map(len, map(c, pieces))) for c in self.compress]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(plain(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        best = sizes[order[0]]
        margin = 1.0 if len(order) < 2 else (sizes[order[1]] - best) / best
        return self.langs[order[0]], min(1.0, margin / SURE), margin < MARGIN


def identify(docs: DataFrame, content: list[tuple[str, bytes]], keys: list[str]) -> DataFrame:
    """``keys``, lang_pred, score and rejected of each document."""
    schema = T.StructType([*(docs.schema[k] for k in keys), *schema_of("lang_pred string, score double, rejected boolean").fields])
    held: list[Classifier] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not held:  # once a worker: compressors can't be sent
            held.append(Classifier(content))
        got = [held[0](t) for t in cols["text"]]
        return {k: cols[k] for k in keys} | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "rejected": [x[2] for x in got]}

    return map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema, binary=())
