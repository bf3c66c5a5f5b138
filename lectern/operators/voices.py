"""Speakers of chunks carried over to global ones, as a fold over a video's chunks or as state of a stream."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold

SEAM_MS, VOICE, LEAST_MS, LOOK_BACK_MS = 400, 0.82, 50, 20_000
TURNS = "start_ms long, end_ms long, speaker string"


def _unit(vector) -> np.ndarray | None:
    v = np.asarray(vector, dtype=float)
    norm = float(np.linalg.norm(v)) if v.size else 0.0
    return v / norm if norm >= 1e-8 and np.isfinite(norm) else None


def _one_to_one(pairs: list[tuple[float, str, str]], least: float, mapping: dict[str, str]) -> None:
    """Adds the best pairs to mapping, each side once."""
    for score, local, known in sorted(pairs, key=lambda p: -p[0]):
        if score >= least and local not in mapping and known not in mapping.values():
            mapping[local] = known


def begin() -> dict:
    return {"done": 0, "next": 0, "turns": [], "gallery": {}}


def stitch_chunk(state: dict, end_ms: int, turns: list[dict], voices: dict[str, list[float]]) -> list[tuple[int, int, str]]:
    """A chunk's new turns under global speakers; the state moves on.

    A chunk that ends at or before what is done is a repeat and gives nothing. The state keeps the turns that a later
    chunk can look back to, and one vector with its weight for each speaker.
    """
    after = state["done"]
    if end_ms <= after:
        return []
    spoken: dict[str, int] = {}
    for t in turns:
        spoken[t["speaker"]] = spoken.get(t["speaker"], 0) + max(0, t["end_ms"] - t["start_ms"])
    units = {s: u for s in spoken if (u := _unit(voices.get(s) or [])) is not None}
    mapping: dict[str, str] = {}
    if after > 0:
        shared: dict[tuple[str, str], int] = {}
        for t in turns:
            for start, end, known in state["turns"]:
                both = min(t["end_ms"], end) - max(t["start_ms"], start)
                if both > 0:
                    shared[t["speaker"], known] = shared.get((t["speaker"], known), 0) + both
        _one_to_one([(ms, *pair) for pair, ms in shared.items()], SEAM_MS, mapping)
        alike = [(float(u @ g), s, k) for s, u in units.items() for k, (v, _) in state["gallery"].items() if len(g := np.asarray(v)) == len(u)]
        _one_to_one(alike, VOICE, mapping)
    for s in spoken:
        if s not in mapping:
            mapping[s] = f"SPEAKER_{state['next']:02d}"
            state["next"] += 1
    for s, u in units.items():
        weight = max(spoken[s] / 1000, 0.05)
        old, had = state["gallery"].get(mapping[s], ([], 0.0))
        mixed = u if len(old) != len(u) else (had * np.asarray(old) + weight * u) / (had + weight)
        kept = _unit(mixed)
        state["gallery"][mapping[s]] = ((u if kept is None else kept).tolist(), weight + (had if len(old) == len(u) else 0.0))
    new = [(max(t["start_ms"], after), t["end_ms"], mapping[t["speaker"]]) for t in turns if t["end_ms"] > after]
    new = [t for t in new if t[1] - t[0] >= LEAST_MS]
    state["done"] = end_ms
    state["turns"] = [t for t in [*state["turns"], *new] if t[1] > end_ms - LOOK_BACK_MS]
    return new


def packed(chunks: DataFrame) -> DataFrame:
    """chunks with turns (array of structs) and voices (map) as JSON, as the fold and the stream take them."""
    return chunks.withColumn("turns", F.to_json("turns")).withColumn("voices", F.to_json("voices"))


def stitch_turns(chunks: DataFrame) -> DataFrame:
    """video_id, chunk_no, start_ms, end_ms, speaker: the turns of all chunks under global speakers.

    chunks: video_id, chunk_no, end_ms, turns array<struct<start_ms, end_ms, speaker>> in order, voices map<speaker, vector>
    (null: none). A chunk's speakers are mapped by the time they share with earlier turns, then by voice, else are new.
    """

    def step(state, chunk_no, end_ms, turns, voices):
        for t in stitch_chunk(state, end_ms, json.loads(turns or "[]"), json.loads(voices or "{}")):
            yield chunk_no, *t

    return ordered_fold(packed(chunks), ["video_id"], ["chunk_no"], ["chunk_no", "end_ms", "turns", "voices"], begin, step, f"chunk_no long, {TURNS}")
