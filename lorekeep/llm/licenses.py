"""Licence scan by a trained paragraph classifier (operator 6).

A logistic regression on sparse word n-grams tells licence families and "unknown" apart, line by line and over windows of
lines that no blank line parts, as notices are usually wrapped. It is trained on variants of short licence notices, on near
misses (notices of licences that are no family here) and on paragraphs of a bounded sample of documents; its probabilities are
calibrated by a temperature on variants kept aside. A prediction stands only where a template of the family confirms it: the
paragraph holds most of the template's pairs of words, the words that tell the family from its kin (versions, modifiers) are
among what was matched, and words of its kin are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table, text_or_empty

UNKNOWN = "unknown"
#: Documents whose paragraphs teach what no licence looks like, paragraphs of each, and the longest paragraph taken.
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 300, 20, 20_000
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
#: A wrapped notice lies within so many times the words of its template.
WINDOW = 1.5
SEED = 6

#: Notices of each family, as their licences or common usage word them.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD License."],
    "bsd-2-clause": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without prior written permission."],
}
#: Notices of licences that are no family here.
NEAR_MISSES = [
    "Licensed under the Apache License, Version 1.1.", "Licensed under the Apache License, Version 1.0.", "Licensed under the Mozilla Public License, version 1.1.",
    "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the zlib License.", "Licensed under the Artistic License 2.0.", "Licensed under the BSD 4-Clause License.",
    "Released under the Boost Software License, Version 1.0.", "This work is licensed under the GNU Free Documentation License, version 1.3.", "Licensed under the European Union Public Licence, version 1.2.",
    "The rights of all readers are reserved for another day.", "Permission was granted to the visitors of the garden.", "The public domain of the king lies in the north.",
]
_NC, _SA, _ND = {"nc", "noncommercial"}, {"sa", "sharealike"}, {"nd", "noderivatives", "noderivs"}
_BY, _KIN = {"by", "attribution"}, {"lesser", "library", "lgpl", "affero", "agpl"}
#: What a match must hold, a word of each set, and what it must not.
MARKS = {
    "agpl": ([{"affero", "agpl"}], {"lesser", "lgpl"}),
    "apache-2.0": ([{"apache"}, {"2.0", "v2", "v2.0"}], {"1.0", "1.1"}),
    "bsd": ([{"bsd", "redistribution"}], {"4"}),
    "bsd-2-clause": ([{"bsd"}, {"2"}], {"3", "4"}),
    "bsd-3-clause": ([{"bsd"}, {"3"}], {"2", "4"}),
    "cc-by": ([_BY], _NC | _SA | _ND),
    "cc-by-nc": ([_BY, _NC], _SA | _ND),
    "cc-by-nc-nd": ([_BY, _NC, _ND], _SA),
    "cc-by-nc-sa": ([_BY, _NC, _SA], _ND),
    "cc-by-nd": ([_BY, _ND], _NC | _SA),
    "cc-by-sa": ([_BY, _SA], _NC | _ND),
    "gpl": ([{"general", "gpl"}], _KIN),
    "isc": ([{"isc", "distribute"}], {"mit"}),
    "lgpl": ([{"lesser", "library", "lgpl"}], {"affero", "agpl"}),
    "mit": ([{"mit", "deal", "obtaining"}], {"isc"}),
    "mpl-2.0": ([{"mozilla"}, {"2.0"}], {"1.0", "1.1"}),
    "public-domain": ([{"domain"}], set()),
    "reserved": ([{"reserved", "reproduced"}], set()),
}
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_FAMILIES = [*sorted(TEMPLATES), UNKNOWN]


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(words: list[str]) -> set:
    """Words and pairs of neighbouring words."""
    return {*words, *zip(words, words[1:])}


@dataclass(frozen=True)
class Scanner:
    """Bounded by the templates: features are the n-grams that they hold."""

    vocabulary: dict
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, str, frozenset]]

    @cached_property
    def holders(self) -> dict:
        """The templates (by place in the list) that hold each pair of words."""
        found: dict = {}
        for k, (_, _, pairs) in enumerate(self.templates):
            for pair in pairs:
                found.setdefault(pair, []).append(k)
        return found

    def features(self, words: list[str]) -> list[int]:
        found = map(self.vocabulary.get, grams(words))
        return [f for f in found if f is not None]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        scores = np.tile(self.bias, (len(rows), 1))
        sizes = np.array([len(r) for r in rows])
        if sizes.sum():
            at = np.repeat(np.arange(len(rows)), sizes)
            np.add.at(scores, at, self.weights[np.concatenate([np.array(r, np.intp) for r in rows if r])])
        return _softmax(scores / self.temperature)

    def similarity(self, words: list[str], family: str, marked: bool = True) -> tuple[float, str]:
        """The largest share of a template's pairs of words that the paragraph holds, among the family's templates, with `marked` those whose match has its marks."""
        pairs = list(zip(words, words[1:]))
        there = set(pairs)
        best = (0.0, "")
        for f, name, t in self.templates:
            if f == family:
                found = (len(there & t) / len(t), name)
                if found > best and (found[0] <= 0 or not marked or self._marked(words, [k for k, p in enumerate(pairs) if p in t], family)):
                    best = found
        return best

    @staticmethod
    def _marked(words: list[str], at: list[int], family: str) -> bool:
        """Whether what was matched, from the first pair to the last, holds the family's marks and none of its kin's."""
        must, never = MARKS[family]
        end = at[-1] + 2
        # a modifier that follows the last matched word belongs to it
        held = words[at[0] : end + (words[end - 1] in _BY)]
        return all(not m.isdisjoint(held) for m in must) and never.isdisjoint(held)

    def wrapped(self, lines: list[list[str]], min_similarity: float) -> list[tuple[int, int, list[str]]]:
        """First line, last line and words of each place where a run of lines holds `min_similarity` of a template's pairs
        within WINDOW times its words. `lines` are words by line, none for a blank one, which no window crosses."""
        words = [w for line in lines for w in line]
        of_line = [k for k, line in enumerate(lines) for _ in line]
        places: list[list[tuple[int, tuple]]] = [[] for _ in self.templates]
        for at, pair in enumerate(zip(words, words[1:])):
            if (held := self.holders.get(pair)) and of_line[at + 1] - of_line[at] < 2:
                for t in held:
                    places[t].append((at, pair))
        found = []
        for (_, _, pairs), hits in zip(self.templates, places):
            need, width = min_similarity * len(pairs), int(WINDOW * (len(pairs) + 1))
            if len({pair for _, pair in hits}) < need:
                continue
            for k, (start, _) in enumerate(hits):
                seen: set = set()
                end = line = start
                for m in range(k, len(hits)):
                    at, pair = hits[m]
                    if at + 2 - start > width or self._parted(lines, of_line[line], of_line[at]):
                        break
                    line = at
                    if pair not in seen:
                        seen.add(pair)
                        end = at + 1
                if len(seen) >= need and of_line[start] != of_line[end]:
                    found.append((len(seen), len(seen) / len(pairs), start, end))
        # the most pairs first, so that a window that is mostly within a better one goes
        taken: dict[int, list[tuple[int, int]]] = {}
        most = int(WINDOW * (1 + max(len(pairs) for _, _, pairs in self.templates)))
        for _, _, start, end in sorted(found, key=lambda x: (-x[0], -x[1], x[3] - x[2], x[2])):
            near = [x for b in (-1, 0, 1) for x in taken.get(start // most + b, [])]
            if all(2 * (min(end, e) - max(start, s) + 1) <= min(end - start, e - s) + 1 for s, e in near):
                taken.setdefault(start // most, []).append((start, end))
        return [(of_line[s], of_line[e], words[s : e + 1]) for s, e in sorted(x for b in taken.values() for x in b)]

    @staticmethod
    def _parted(lines: list[list[str]], first: int, last: int) -> bool:
        return last - first > 1 and not all(lines[first + 1 : last])


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(paragraphs: list[str], variants: int = 40, rounds: int = 300, decay: float = 1e-3) -> Scanner:
    """A scanner from the templates and paragraphs that aren't licences; those that hold a template are left out."""
    rng = np.random.default_rng(SEED)
    vocabulary: dict = {}
    templates = []
    for family in sorted(TEMPLATES):
        for k, text in enumerate(TEMPLATES[family]):
            words = words_of(text)
            templates.append((family, f"{family}/{k}", frozenset(zip(words, words[1:]))))
            for g in sorted(grams(words), key=str):
                vocabulary.setdefault(g, len(vocabulary))
    blank = Scanner(vocabulary, np.zeros((len(vocabulary), len(_FAMILIES))), np.zeros(len(_FAMILIES)), 1.0, templates)
    others = [w for w in map(words_of, paragraphs) if max(blank.similarity(w, f)[0] for f in TEMPLATES) < MIN_SIMILARITY]
    filler = [w for p in others for w in p] or ["text"]
    known = sorted({g for g in vocabulary if isinstance(g, str)})
    rows: list[list[int]] = []
    classes: list[int] = []

    def add(words: list[str], family: str) -> None:
        rows.append(blank.features(words))
        classes.append(_FAMILIES.index(family))

    def around() -> list[str]:
        return [str(filler[k]) for k in rng.integers(0, len(filler), rng.integers(0, 40))]

    for family in sorted(TEMPLATES):
        for text in TEMPLATES[family]:
            words = words_of(text)
            add(words, family)
            for _ in range(variants):
                kept = [w for w in words if rng.random() > 0.1] or words
                add(around() + kept + around() if rng.random() < 0.5 else kept, family)
    for words in others:
        add(words, UNKNOWN)
    for text in NEAR_MISSES:
        words = words_of(text)
        for _ in range(variants // 2):
            add(around() + words + around() if rng.random() < 0.5 else words, UNKNOWN)
    for _ in range(40 * variants):
        # single words of notices in other company say nothing
        add(around() + [known[k] for k in rng.integers(0, len(known), rng.integers(0, 4))] + around(), UNKNOWN)
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.array(classes)
    for k, r in enumerate(rows):
        x[k, r] = 1
    tuning = rng.random(len(rows)) < 0.2
    goal = np.eye(len(_FAMILIES), dtype=np.float32)[y]
    weights, bias = np.zeros((x.shape[1], len(_FAMILIES)), np.float32), np.zeros(len(_FAMILIES), np.float32)
    xs, gs = x[~tuning], goal[~tuning]
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rounds):
        off = (_softmax(xs @ weights + bias) - gs) / len(xs)
        speed_w = 0.9 * speed_w - 2.0 * (xs.T @ off + decay * weights / 10)
        speed_b = 0.9 * speed_b - 2.0 * off.sum(0)
        weights, bias = weights + speed_w, bias + speed_b
    scores = x[tuning] @ weights + bias

    def loss(t: float) -> float:
        return -float(np.log(_softmax(scores / t)[np.arange(len(scores)), y[tuning]] + 1e-12).mean()) if len(scores) else 0.0

    return Scanner(vocabulary, weights.astype(float), bias.astype(float), min(np.geomspace(0.25, 4, 33), key=loss), templates)


def sample_paragraphs(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, paragraphs: int = SAMPLE_PARAGRAPHS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Whole paragraphs, drawn by hash, of the documents whose doc_ids have the smallest hashes; for training alone. Longer ones than `chars` are not drawn."""
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda p: (F.trim(p) != "") & (F.char_length(p) <= chars))
    drawn = F.slice(F.array_sort(F.transform(lines, lambda p, k: F.struct(F.xxhash64("doc_id", k).alias("h"), p.alias("p")))), 1, paragraphs)
    # the ids are chosen first, so tasks send texts of chosen documents alone
    chosen = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(documents)
    found = docs.join(F.broadcast(chosen.distinct()), "doc_id").select("h", F.transform(drawn, lambda x: x["p"]).alias("p")).orderBy("h").limit(documents).collect()
    return [p for r in found for p in r.p]


def scan(docs: DataFrame, scanner: Scanner, min_probability: float = MIN_PROBABILITY, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    r"""For each row of `docs` (doc_id, text): doc_id, n_paragraphs (\n-parted, with a word), n_predicted (paragraphs
    whose likeliest class is a family, at `min_probability`), n_confirmed, families (the confirmed ones, ascending) and
    `found`: paragraph (its line from 0), family, probability, template, similarity, confirmed of each predicted one.

    A notice wrapped over lines that no blank line parts is one more paragraph, in n_predicted, n_confirmed and `found`
    (by its first line) where a template confirms it. It gives way to a confirmed line of its family, and takes the
    place of lines of other families that it holds whole. n_paragraphs counts lines alone.

    Null, empty and wordless texts have no paragraphs. Repeated rows and null doc_ids give a row each; other columns are
    not read; an empty table gives no rows. Whole texts are scanned.
    """
    names = ["doc_id", "n_paragraphs", "found"]
    item = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.string()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])

    def with_wrapped(found: list[dict], lines: list[list[str]]) -> list[dict]:
        windows = scanner.wrapped(lines, min_similarity)
        if not windows:
            return found
        p = scanner.probabilities([scanner.features(w) for _, _, w in windows])
        for (first, last, words), row in zip(windows, p):
            k = int(row.argmax())
            family = _FAMILIES[k]
            if family == UNKNOWN or row[k] < min_probability:
                continue
            similarity, template = scanner.similarity(words, family)
            inside = [x for x in found if x["confirmed"] and first <= x["paragraph"] <= last]
            if similarity < min_similarity or any(x["family"] == family for x in inside):
                continue
            gone = [x for x in inside if scanner.similarity(words, x["family"], marked=False)[0] >= x["similarity"]]
            found = [x for x in found if x not in gone]
            found.append({"paragraph": first, "family": family, "probability": float(row[k]), "template": template, "similarity": similarity, "confirmed": True})
        return sorted(found, key=lambda x: x["paragraph"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for text in batch.column(1).to_pylist():
                lines = [words_of(p) for p in text.split("\n")]
                places = [(k, w) for k, w in enumerate(lines) if w]
                counts.append(len(places))
                found = []
                if places:
                    p = scanner.probabilities([scanner.features(w) for _, w in places])
                    best = p.argmax(1)
                    for k in np.flatnonzero((best < len(_FAMILIES) - 1) & (p.max(1) >= min_probability)):
                        family = _FAMILIES[best[k]]
                        similarity, template = scanner.similarity(places[k][1], family)
                        found.append({"paragraph": places[k][0], "family": family, "probability": float(p[k, best[k]]), "template": template, "similarity": similarity, "confirmed": similarity >= min_similarity})
                if len(places) > 1:
                    found = with_wrapped(found, lines)
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.list_(item))], names)

    fields = "paragraph int, family string, probability double, template string, similarity double, confirmed boolean"
    rows = in_arrow(docs.select("doc_id", text_or_empty().alias("text")), scanned, f"doc_id long, n_paragraphs long, found array<struct<{', '.join(x.replace(' ', ':') for x in fields.split(', '))}>>")
    confirmed = F.filter("found", lambda x: x["confirmed"])
    return rows.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"), F.size(confirmed).cast("long").alias("n_confirmed"),
        F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["family"]))).alias("families"), "found",
    )


def op6_paragraph_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(sample_paragraphs(docs)))


QUERIES = {"op6_paragraph_licenses": op6_paragraph_licenses}
ORACLE_SQL: dict[str, str] = {}
