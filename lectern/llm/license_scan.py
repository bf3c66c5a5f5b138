"""License scans by a positional index of rare tokens.

The index holds, of each template, its rarest words (by inverse document frequency over all documents), until what is left of
its weight couldn't reach AGREE any more: a file without any of these can't match, so the templates that a file is held against are those
its words lead to, however many there are. For each of them whose mandatory phrases' words are all in the file, the postings of its words
in the file vote, by weight, at the offset (position in file - position in template). Words put in or left out move
the offsets of what follows, so the votes of up to BAND neighbouring offsets count together. A template is a match where words of enough
of its weight agree and its mandatory phrases stand in the aligned span.

Defined cases: null or empty text: no words, no labels, score 0, null positions; repeated rows alike, each by
itself; any number of words. Document frequencies are counted over every document; with no documents all
words weigh the same.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, schema_of

# fixed values: the base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: naming sentences and openings of public licences; (label, words of the template, mandatory phrases)
SENTENCES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall be included",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("deal in the software without restriction",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law or agreed to in writing",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the public domain under the cc0 1 0 universal dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)
# fixed values: short names as they stand after "SPDX-License-Identifier:", and labels
SPDX = (
    ("MIT", "mit"), ("Apache-2.0", "apache"), ("GPL-2.0", "gpl"), ("GPL-3.0", "gpl"), ("LGPL-2.1", "lgpl"), ("LGPL-3.0", "lgpl"), ("AGPL-3.0", "agpl"), ("BSD-2-Clause", "bsd"), ("BSD-3-Clause", "bsd"),
    ("MPL-2.0", "mpl"), ("CC-BY-4.0", "cc-by"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC-BY-NC-4.0", "cc-by-nc"), ("CC0-1.0", "cc0"), ("Unlicense", "unlicense"), ("ISC", "isc"), ("Zlib", "zlib"), ("BSL-1.0", "boost"), ("EPL-2.0", "epl"),
)
# fixed values: names by which a text says what it is under, and labels
NAMES = (("mit", "mit"), ("the mit", "mit"), ("apache 2 0", "apache"), ("the apache", "apache"), ("gnu gpl", "gpl"), ("the gnu gpl", "gpl"), ("gpl v3", "gpl"), ("gplv3", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("the bsd", "bsd"), ("mpl 2 0", "mpl"), ("isc", "isc"), ("the unlicense", "unlicense"))


def named_templates() -> tuple[tuple[str, str, tuple[str]], ...]:
    """Templates of the identifiers and of the short names, each mandatory as a whole."""
    words = lambda name: name.lower().replace("-", " ").replace(".", " ")
    told = [(label, f"spdx license identifier {words(name)}") for name, label in SPDX] + [(label, f"{verb} under {name}") for name, label in NAMES for verb in ("licensed", "released", "distributed")]
    return tuple((label, text, (text,)) for label, text in [*told, ("gpl", "gnu gpl v2"), ("gpl", "gnu gpl v3")])


#: Offsets on either side whose votes count together.
BAND = 2
#: Share of a template's total weight that has to agree at an offset.
AGREE = 0.5

_TO_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_APART = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SPACE = bytes.maketrans(_APART, b" " * len(_APART))
_BASE = [(f" {p} ".encode(), label) for p, label in BASE.items()]


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of 0-9, A-Z (lowered), a-z and anything beyond ASCII."""
    return (text or b"").translate(_TO_LOWER).translate(_SPACE).split()


Template = tuple[str, str, tuple[str, ...]]
TEMPLATES: tuple[Template, ...] = SENTENCES + named_templates()


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> frozenset[bytes]:
    return frozenset(w.encode() for _, t, _ in templates for w in t.split())


VOCABULARY = vocabulary()


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that have each template word: as many rows as these words at most."""
    known = vocabulary(templates)
    schema = schema_of("word string, n long")

    def run(cols: dict[str, list]) -> dict[str, list]:
        seen: Counter = Counter()
        for t in cols["text"]:
            seen.update(known.intersection(words_of(t)))
        return {"word": ["", *(w.decode() for w in seen)], "n": [len(cols["text"]), *seen.values()]}

    got = {r.word: r.n for r in map_rows(docs.select("text"), run, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), {w.encode(): n for w, n in got.items()}


class Scanner:
    def __init__(self, n_docs: int, df: dict[bytes, int], templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.known = vocabulary(templates)
        self.weight = {w: float(np.log((n_docs + 1) / (df.get(w, 0) + 1)) + 0.1) for w in self.known}
        self.names = [label for label, _, _ in templates]
        self.templates = [([w.encode() for w in t.split()], [tuple(x.encode() for x in p.split()) for p in need]) for _, t, need in templates]
        self.total = [sum(self.weight[w] for w in t) for t, _ in self.templates]
        self.index: dict[bytes, list[int]] = defaultdict(list)
        for k, (words, _) in enumerate(self.templates):
            count, seen = Counter(words), 0.0
            for w in sorted(count, key=lambda w: (-self.weight[w], w)):
                if seen > (1 - AGREE) * self.total[k] + 1e-9:
                    break
                seen += self.weight[w] * count[w]
                self.index[w].append(k)
        self.keys = frozenset(self.index)

    def labels(self, words: list[bytes]) -> tuple[set[str], float]:
        if self.keys.isdisjoint(words):
            return set(), 0.0
        by_word = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.known:
                by_word[w].append(i)
        led = {k for w in by_word.keys() & self.keys for k in self.index[w]}
        live = [k for k in sorted(led) if all(w in by_word for p in self.templates[k][1] for w in p)]  # others can't have their phrases
        places = {w: np.array(p) for w, p in by_word.items()}
        found, best = set(), 0.0
        for k in live:
            template, need = self.templates[k]
            n, label = len(template), self.names[k]
            votes = np.zeros(len(words) + n + 2 * BAND)  # by offset, from -(n + BAND) on
            for p, w in enumerate(template):
                if w in places:
                    votes[places[w] - p + n + BAND] += self.weight[w]
            upto = np.concatenate([[0.0], votes.cumsum()])
            band = upto[2 * BAND + 1 :] - upto[: -2 * BAND - 1]  # of the 2 BAND + 1 offsets from each on: no less than what agrees
            for at in np.flatnonzero(band >= AGREE * self.total[k] - 1e-9).tolist():
                if label in found and min(1.0, band[at] / self.total[k]) <= best:
                    continue
                offset = at - n
                v = sum(self.weight[w] for p, w in enumerate(template) if w in words[max(offset + p - BAND, 0) : max(offset + p + BAND + 1, 0)])
                if v < AGREE * self.total[k]:
                    continue
                span = words[max(offset - BAND, 0) : offset + n + BAND]
                if all(any(tuple(span[j : j + len(p)]) == p for j in range(len(span) - len(p) + 1)) for p in need):
                    found.add(label)
                    best = max(best, min(1.0, v / self.total[k]))
        return found, best


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place of a base phrase; one walk a phrase."""
    text = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in _BASE:
        at, before, n = text.find(phrase), 0, 0
        while at >= 0:
            n += text.count(b" ", before, at)
            found.append((n, label))
            before, at = at, text.find(phrase, at + 1)
    return found


def scan(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    schema = T.StructType([*(docs.schema[k] for k in keys), *schema_of("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").fields])
    scanner = Scanner(*frequencies(docs))

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema} | {k: cols[k] for k in keys}
        for t in cols["text"]:
            words = words_of(t)
            places = base_places(words)
            own, score = scanner.labels(words)
            base = {label for _, label in places}
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min((i for i, _ in places), default=None))
            out["last_word"].append(max((i for i, _ in places), default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | own)))
            out["score"].append(max(score, 1.0 if base else 0.0))
        return out

    return map_rows(docs.select(*dict.fromkeys([*keys, "text"])), run, schema)
