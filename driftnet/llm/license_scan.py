"""Licence scans by a positional rare-token index.

Licence templates are indexed by word and position. Of each template so many of its highest-IDF words are looked up that an alignment which
reaches the threshold must hold VOTES of them (the prefix principle), however common the words are; no template depends on what else the file holds. Postings
vote for (template, offset), so that words count only where they stand at the same relative positions as in the template. Alignments with the votes are scored
over the whole template, and a label is given when the score reaches the threshold and one of the template's mandatory phrases stands in the file.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rule: phrase and label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: label, mandatory phrases (each alternative is enough), template text. Public licence notices and headers.
TEMPLATES = [
    ("mit", ["permission is hereby granted free of charge"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", ["mit license"], "Released under the MIT License"),
    ("mit", ["mit license"], "This project is licensed under the terms of the MIT License"),
    ("apache", ["apache license"], "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", ["apache license"], "Licensed under the Apache License, Version 2.0"),
    ("gpl", ["general public license"], "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", ["general public license"], "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", ["redistribution and use in source and binary forms"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", ["permission to use copy modify and or distribute this software"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", ["mozilla public license"], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", ["released into the public domain"], "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", ["cc by 4 0", "creative commons attribution 4 0"], "This work is licensed under CC BY 4.0"),
    ("cc-by-sa", ["cc by sa 4 0", "creative commons attribution sharealike 4 0"], "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"], "Licensed under CC BY-NC 4.0"),
    ("cc0", ["cc0 1 0", "cc0 public domain dedication"], "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
    ("proprietary", ["all rights reserved"], "Copyright. All rights reserved. No part of this work may be reproduced or distributed without permission"),
]
#: Share of a template's words that must stand at their places.
THRESHOLD = 0.6
#: Looked up words that an alignment must hold.
VOTES = 2

#: ASCII bytes that are neither letters nor digits part words, A-Z become a-z; all other characters belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Phrase:
    """Finds the places where its words stand one after the other."""

    def __init__(self, phrase: str) -> None:
        self.words = split_words(phrase)

    def places(self, words: list[bytes], where: dict[bytes, list[int]]) -> list[int]:
        last = self.words[-1]
        n = len(self.words)
        return [k - n + 1 for k in where.get(last, ()) if k >= n - 1 and words[k - n + 1 : k + 1] == self.words]


class TemplateIndex:
    """Templates by word and position, with the document frequencies of their words."""

    def __init__(self, templates=TEMPLATES, base=BASE, frequency: dict[bytes, int] | None = None, documents: int = 0) -> None:
        self.labels = [label for label, _, _ in templates]
        self.words = [split_words(text) for _, _, text in templates]
        self.keys = [[Phrase(p) for p in phrases] for _, phrases, _ in templates]
        self.base = [(Phrase(p), label) for p, label in base]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for k, w in enumerate(words):
                self.postings[w].append((t, k))
        frequency = frequency or {}
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in self.postings}
        self.needed = [math.ceil(THRESHOLD * len(words)) for words in self.words]
        self.probes: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            due = len(words) - self.needed[t] + min(VOTES, self.needed[t])
            for w in sorted(set(words), key=lambda w: (-self.idf[w], w)):
                if due <= 0:
                    break
                places = [(t, k) for k, own in enumerate(words) if own == w]
                self.probes[w] += places
                due -= len(places)
        self.wanted = frozenset(self.probes.keys() | {p.words[-1] for keys in self.keys for p in keys} | {p.words[-1] for p, _ in self.base})

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of a whole text."""
        words = split_words(text)
        where: dict[bytes, list[int]] = {w: [] for w in self.wanted.intersection(words)}
        if where:
            for k, w in enumerate(words):
                if w in where:
                    where[w].append(k)
        starts, base_labels = [], set()
        for phrase, label in self.base:
            if found := phrase.places(words, where):
                starts += found
                base_labels.add(label)
        labels, score = set(base_labels), 0.0
        for t, own in self.aligned(words, where):
            if own > score:
                score = own
            if any(p.places(words, where) for p in self.keys[t]):
                labels.add(self.labels[t])
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(score, 6)

    def aligned(self, words: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[int, float]]:
        """Templates with their best share of words in place, where it is THRESHOLD or more."""
        votes: Counter = Counter()
        for w in self.probes.keys() & where.keys():
            for t, k in self.probes[w]:
                votes.update((t, p - k) for p in where[w])
        best: dict[int, float] = {}
        for (t, offset), n in votes.items():
            own, needed = self.words[t], self.needed[t]
            if n < min(VOTES, needed):
                continue
            a = max(0, -offset)
            placed = sum(map(bytes.__eq__, own[a:], words[offset + a : offset + len(own)]))
            if placed >= needed:
                best[t] = max(best.get(t, 0.0), placed / len(own))
        return sorted(best.items())


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that each licence word stands in, over all of docs, and their number. The vocabulary bounds what comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count[""] += 1
                count.update(w.decode() for w in vocabulary.intersection(split_words(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    total = found.pop("", 0)
    return {w.encode(): n for w, n in found.items()}, total


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty: no words, no labels, score 0.
    Whole texts of any length are scanned; repeated rows and null ids are scanned like any others. score is the best share of a template's words that stand in
    place, 0 below THRESHOLD. Equal inverse document frequencies are ordered by the word itself.
    """
    frequency, total = frequencies(docs, frozenset(TemplateIndex(templates, base).postings))
    index = TemplateIndex(templates, base, frequency, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [index.scan(t or "") for t in batch.column(1).to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *added], names=["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, {FIELDS}")
