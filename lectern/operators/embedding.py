"""Vectors of texts by a model given as a function of a list of texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, text: str, model: Model, dim: int = 768, query: bool = False, rows: int = 16) -> DataFrame:
    """df with `embedding` (array<float>, unit norm; null for a null text), `rows` texts a call.

    Texts begin with "query: " or "passage: ", their line ends are spaces. A vector of another length is an error.
    """

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list = [None] * len(batch)
            known = [i for i, t in enumerate(batch) if t is not None]
            for k in range(0, len(known), rows):
                part = known[k : k + rows]
                made = np.asarray(model([batch.iloc[i] for i in part]), dtype=float)
                if made.shape != (len(part), dim):
                    raise ValueError(f"model gave {made.shape}, not {(len(part), dim)}")
                unit = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                for i, v in zip(part, unit):
                    found[i] = v.astype(np.float32)
            yield pd.Series(found)

    vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    told = F.concat(F.lit("query: " if query else "passage: "), F.regexp_replace(text, "[\r\n]+", " "))
    return df.withColumn("embedding", F.pandas_udf(vectors, "array<float>")(told))


def hashing_model(dim: int = 64) -> Model:
    """A stand-in without weights: counts of hashed words, signed by a second bit of the hash."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dim] += 1 if h & 0x10000 else -1
        return out

    return model
