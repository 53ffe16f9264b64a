"""License scans by a positional index of rare words.

One inverted index holds the words of all templates with the templates and positions they stand at, and the words of the highest inverse
document frequency of their mandatory phrases; rarity is counted over all files. A file's words of that kind are looked up, the rarest
first, and lead to the phrases and, where these are verified word by word, to the templates that have all of them; there the postings are
intersected by the difference of the position in the file and in the template, and the largest share of a template's words that agree on
one difference is the score. The work grows with what a file has, not with the number of templates. Rarity only sets the order
of the work: how many files have a word changes neither labels nor scores.

Cases: a null text is empty: no words, no labels, score 0; repeated rows are scanned each by itself; an empty table gives no
rows; extra columns are ignored; a text of any length is scanned whole, and all its places count.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8_slices

#: Words of a text, after A-Z are lower-cased: digits, a-z and all bytes above ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases whose places are counted, with their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, text, mandatory phrases: notices and the telling passages of common licences.
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "in compliance with the license")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software released into the public domain",)),
    ("proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", ("all rights reserved",)),
)


def words_of(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw.lower())


class Index:
    """word -> templates and positions; the rarest word of each mandatory phrase (``leads``) -> phrases; phrase -> templates."""

    def __init__(self, templates, files: int, with_word: dict[bytes, int]):
        words_in = [(label, words_of(text.encode()), [tuple(words_of(p.encode())) for p in phrases]) for label, text, phrases in templates]
        self.idf = {w: math.log((1 + files) / (1 + with_word.get(w, 0))) for _, words, phrases in words_in for w in [*words, *(w for p in phrases for w in p)]}
        self.templates = [(label, len(words), sorted(set(phrases))) for label, words, phrases in words_in]
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(dict)
        self.with_phrase: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for t, (_, words, phrases) in enumerate(words_in):
            for at, w in enumerate(words):
                self.postings[w].setdefault(t, []).append(at)
            for p in set(phrases):
                self.with_phrase[p].append(t)
        self.leads: dict[bytes, list[tuple[list[bytes], int]]] = defaultdict(list)
        for p in self.with_phrase:
            lead = max(range(len(p)), key=lambda k, p=p: (self.idf[p[k]], -k))
            self.leads[p[lead]].append((list(p), lead))
        self.lead_words = frozenset(self.leads)

    def scan(self, words: list[bytes], have: frozenset[bytes] | set[bytes]) -> tuple[set[str], float]:
        """Labels and the best score of a file's words, of which it has the lead words ``have``."""
        at_word: dict[bytes, list[int]] = {w: [] for w in have}
        for at, w in enumerate(words):
            if w in at_word:
                at_word[w].append(at)
        found: dict[tuple[bytes, ...], list[int]] = {}
        for w in sorted(have, key=lambda w: (-self.idf[w], w)):
            for phrase, lead in self.leads[w]:
                own = [at - lead for at in at_word[w] if at >= lead and words[at - lead : at - lead + len(phrase)] == phrase]
                if own:
                    found[tuple(phrase)] = own
        labels, score = set(), 0.0
        for t, n in Counter(t for p in found for t in self.with_phrase[p]).items():
            label, size, phrases = self.templates[t]
            if n < len(phrases):
                continue
            starts = _starts([(found[p], len(p)) for p in phrases], size)
            if starts:
                labels.add(label)
            for low, high in starts:
                votes: Counter = Counter()  # the words in reach vote for starts by their difference of position
                for at in range(max(0, low), min(len(words), high + size)):
                    for place in self.postings[words[at]].get(t, ()) if words[at] in self.postings else ():
                        votes[at - place] += 1
                score = max([score, *(n / size for start, n in votes.items() if low <= start <= high)])
        return labels, score


def _starts(phrases: list[tuple[list[int], int]], size: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of the starts at which a template of ``size`` words has all its phrases (places, length) within it."""
    out: list[tuple[int, int]] | None = None
    for places, length in phrases:
        own: list[tuple[int, int]] = []
        for at in places:
            low = at + length - size
            if own and low <= own[-1][1] + 1:
                own[-1] = own[-1][0], at
            else:
                own.append((low, at))
        out = own if out is None else _overlap(out, own)
        if not out:
            return []
    return out or []


def _overlap(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The common parts of two lists of ranges in order."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        low, high = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if low <= high:
            out.append((low, high))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return out


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of the places where the phrase's words stand one after the other."""
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


_BASE = [([w.encode() for w in phrase.split()], label) for phrase, label in PHRASES]


def _count(vocabulary: frozenset[bytes]) -> Callable:
    """Numbers of files with each of the templates' words, and of files ('')."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            seen: Counter = Counter({b"": batch.num_rows})
            for _, data, offsets in utf8_slices(batch.column(0), 1 << 20):
                raw = data.tobytes().lower()
                for i in range(len(offsets) - 1):
                    seen.update(vocabulary.intersection(_WORD.findall(raw, offsets[i], offsets[i + 1])))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return count


def _scan(index: Index) -> Callable:
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for _, data, offsets in utf8_slices(batch.column(1), 1 << 20):
                raw = data.tobytes().lower()
                for i in range(len(offsets) - 1):
                    words = _WORD.findall(raw, offsets[i], offsets[i + 1])
                    have = index.lead_words.intersection(words)
                    labels, score = index.scan(words, have) if have else (set(), 0.0)
                    base = {label: _places(words, phrase) for phrase, label in _BASE} if b"license" in have or b"license" in words else {}
                    places = [p for own in base.values() for p in own]
                    marks = {label for label, own in base.items() if own}
                    out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(marks)), ",".join(sorted(marks | labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return scan


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    vocabulary = frozenset(w for _, text, phrases in templates for t in (text, *phrases) for w in words_of(t.encode()))
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"].encode(): r["n"] for r in counted.collect()}  # a row for each word of the templates
    index = Index(templates, counts.pop(b"", 0), counts)
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan(index), kind)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
