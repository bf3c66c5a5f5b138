"""Secret scans: patterns for single secrets, and multipart credentials linked by an interval join.

A weak candidate (a bare long random string, which alone is most often no secret) is reported only where
a complementary part lies in the same scope: an access identifier or an endpoint within REACH characters,
and no further than SCOPE_LINES lines away; anywhere in the same block (a [section] of a configuration, or the innermost
braces around both); or the address that the candidate stands in (a password or a key in
a URL, whose path counts segment by segment, without titles). The join is over sorted positions (two binary searches for each
candidate) and block numbers, so no pairs are formed, however many parts a text has.

Defined cases: a null or empty text has no spans; a span is [start, end) in code points of the whole match;
a weak candidate that overlaps a base span is not reported again, and an identifier or a host isn't a candidate;
a candidate has any length from 20 on; repeated rows are scanned each by itself.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, schema_of

REACH = 400
SCOPE_LINES = 6
#: Order of kinds that start at the same place; the method's own kinds follow the base ones.
KINDS = ("assign", "access", "hex", "linked")
PLACEHOLDER = "[SECRET]"

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more

#: Parts of a credential: identifiers and endpoints complement a weak secret.
IDENTIFIER = re.compile(r"AKIA[A-Z0-9]{16,}|\b(?:client|account|tenant|user)_?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9-]{6,}", re.IGNORECASE | re.ASCII)
ADDRESS = re.compile(r"\b(?:https?|postgres|mysql|mongodb|redis|amqp|ftp|s3)://[^\s\"'<>]{4,}", re.IGNORECASE | re.ASCII)
#: A host has a point in its name, so that "server: down" in prose is none.
HOST = re.compile(r"\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?(?:localhost\b|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.IGNORECASE | re.ASCII)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
#: Words and numbers between dashes, as titles stand in a path.
TITLE = re.compile(r"(?:(?:[0-9]+|[A-Z]?[a-z]+|[A-Z]+)(?:[_-]+|$))+", re.ASCII)
#: An address up to its path, and the path.
PATH = re.compile(r"[^:]*://[^/?#]*([^?#]*)")
SEGMENT = re.compile(r"[^/]{20,}")
#: Heads of sections, and braces.
SECTION = re.compile(r"^\[[^\]\n]+\]\x20*$", re.MULTILINE)
BRACE = re.compile(r"[{}]")


UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", re.ASCII)
#: A digit beside a letter, either way.
TURN = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", re.ASCII)


def random_looking(s: str) -> bool:
    """Few repeats, and signs of a generated key: all of upper case, lower case and digits; or one case and digits (base32, base36,
    hexadecimal) that take turns too often for words and numbers, which stand together in names and dates."""
    if UUID.fullmatch(s):
        return True
    digit, lower, upper = any(c.isdigit() for c in s), any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s)
    if not digit or not (lower or upper):
        return False
    different = len(set(s)) * 2
    if lower and upper:
        return different >= min(len(s), 32)
    return different >= min(len(s), 20) and len(TURN.findall(s)) >= max(4, len(s) // 6) and not TITLE.fullmatch(s)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def near(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, to: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """For each [at, to): does an interval of the sorted (starts, ends) lie within REACH and SCOPE_LINES of it?"""
    if not len(starts):
        return np.zeros(len(at), bool)
    line = lambda p: np.searchsorted(breaks, p)
    after = np.searchsorted(starts, to)
    before = np.searchsorted(ends, at, side="right") - 1
    a, b = np.minimum(after, len(starts) - 1), np.maximum(before, 0)
    right = (after < len(starts)) & (starts[a] - to <= REACH) & (line(starts[a]) - line(at) <= SCOPE_LINES)
    left = (before >= 0) & (at - ends[b] <= REACH) & (line(at) - line(ends[b]) <= SCOPE_LINES)
    return right | left


def sections_at(text: str, at: np.ndarray) -> np.ndarray:
    """The number of the [section] that each place is in; 0 before the first."""
    return np.searchsorted(np.array([m.start() for m in SECTION.finditer(text)], np.int64), at, side="right")


def braces_at(text: str, at: np.ndarray) -> np.ndarray:
    """The start of the innermost braces around each place; -1 outside of any."""
    marks, inner, held = [0], [-1], []
    for m in BRACE.finditer(text):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            held.pop()
        marks.append(m.start() + 1)
        inner.append(held[-1] if held else -1)
    return np.array(inner)[np.searchsorted(np.array(marks), at, side="right") - 1]


def shares_block(text: str, parts: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Of each of ``weak``: is one of ``parts`` in the same section, or in the same innermost braces?"""
    ok = np.zeros(len(weak), bool)
    for of, outside in ((sections_at, 0), (braces_at, -1)):
        own = of(text, weak)
        ok |= (own != outside) & np.isin(own, of(text, parts))
    return ok


def overlapped(spans: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row [start, end) of ``w``: does one of the sorted ``spans`` overlap it?"""
    if not len(spans):
        return np.zeros(len(w), bool)
    over = np.searchsorted(spans[:, 0], w[:, 1]) - 1
    return (over >= 0) & (np.maximum.accumulate(spans[:, 1])[np.maximum(over, 0)] > w[:, 0])


def weak_spans(text: str, addresses: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates; in the path of an address its segments, but for titles."""
    paths = [PATH.match(text, s, e).span(1) for s, e in addresses]
    found, k = [], 0
    for m in WEAK.finditer(text):
        s, e = m.span()
        while k < len(paths) and paths[k][1] <= s:
            k += 1
        cut = e if k == len(paths) else min(max(s, paths[k][0]), e)  # where a path begins
        if cut - s >= 20 and random_looking(text[s:cut]):
            found.append((s, cut))
        found += [x.span() for x in SEGMENT.finditer(text, cut, e) if random_looking(x[0]) and not TITLE.fullmatch(x[0])]
    return found


def linked_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates with a complementary part in their scope, or around them."""
    addresses = [m.span() for m in ADDRESS.finditer(text)]
    own = [m.span() for p in (IDENTIFIER, HOST) for m in p.finditer(text)]
    parts = sorted({*addresses, *own})
    if not parts:
        return []
    weak = weak_spans(text, addresses)
    if not weak:
        return []
    w, p, a = np.array(weak), np.array(parts), np.array(addresses).reshape(-1, 2)
    held = np.array(sorted([(s, e) for s, e, _ in taken] + own)).reshape(-1, 2)
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
    ok = ~overlapped(held, w) & (overlapped(a, w) | near(p[:, 0], np.maximum.accumulate(p[:, 1]), w[:, 0], w[:, 1], breaks) | shares_block(text, p[:, 0], w[:, 0]))
    return [(int(s), int(e), "linked") for s, e in w[ok]]


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in in_order(spans))


def scan(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, and spans: array of (kind, start, end) in order, of each document."""
    schema = T.StructType([*(docs.schema[k] for k in keys), *schema_of("spans array<struct<kind string, start long, end long>>").fields])

    def run(cols: dict[str, list]) -> dict[str, list]:
        out = []
        for t in cols["text"]:
            base = base_spans(t or "")
            out.append([{"kind": k, "start": s, "end": e} for s, e, k in in_order(base + linked_spans(t or "", base))])
        return {k: cols[k] for k in keys} | {"spans": out}

    return map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema, binary=())


def digests(docs: DataFrame) -> DataFrame:
    """One row for each document: numbers of base spans, their digest, and all spans as text."""
    schema = T.StructType([docs.schema["doc_id"], *schema_of("n_assign long, n_access long, n_hex long, base_sha256 string, spans string").fields])

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema}
        out["doc_id"] = cols["doc_id"]
        for t in cols["text"]:
            base = base_spans(t or "")
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + linked_spans(t or "", base)))
        return out

    return map_rows(docs.select("doc_id", "text"), run, schema, binary=())


def redacted(text: str) -> str:
    """The text with each union of overlapping spans replaced by PLACEHOLDER."""
    base = base_spans(text)
    out, at = [], 0
    for s, e, _ in in_order(base + linked_spans(text, base)):
        if s >= at:
            out += [text[at:s], PLACEHOLDER]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; n_chars, where there is such a column, follows the text."""
    schema, columns = docs.schema, docs.columns

    def run(cols: dict[str, list]) -> dict[str, list]:
        cols["text"] = [t if t is None else redacted(t) for t in cols["text"]]
        return cols

    out = map_rows(docs, run, schema, binary=())
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(schema["n_chars"].dataType))
    return out.select(*columns)
