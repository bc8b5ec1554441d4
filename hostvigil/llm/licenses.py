"""Licence scan: templates found by their rarest words at the right distances, confirmed by mandatory phrases."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostvigil.llm.common import named, text_function, without
from hostvigil.llm.decontaminate import words

RARE = 4  # rare words of a template that are looked up in a file
SLACK = 6  # words by which a copy may be longer or shorter than its template up to any place
COVERAGE = 0.6  # share of a template's words that must stand in their places
BASE_SCORE = 0.5  # of a file with base phrases and no template
OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


# Phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licence notices, with the phrases that a copy must hold.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("except in compliance with the license", "apache org licenses")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT license", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted", "free of charge", "to deal in the software")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("under the terms of the gnu general public license", "free software foundation")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license", "free software foundation")),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("bsd", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "waived all copyright")),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("reserved", "All rights reserved", ("all rights reserved",)),
)


class Places:
    """The words of a text, where phrases stand, and where chosen words stand."""

    def __init__(self, text: str):
        self.words = words(text)
        self.distinct = frozenset(self.words)
        self.joined = b" " + b" ".join(self.words) + b" "
        self.known: dict[tuple[bytes, ...], np.ndarray] = {}

    def of_phrase(self, phrase: tuple[bytes, ...]) -> np.ndarray:
        """Index of the first word at each place where the words of the phrase stand one after another."""
        if phrase not in self.known:
            out: list[int] = []
            if self.distinct.issuperset(phrase):
                wanted, at, index = b" " + b" ".join(phrase) + b" ", 0, 0
                found = self.joined.find(wanted)
                while found >= 0:
                    index += self.joined.count(b" ", at, found)
                    out.append(index)
                    at = found
                    found = self.joined.find(wanted, found + 1)
            self.known[phrase] = np.array(out, np.int64)
        return self.known[phrase]

    def of_word(self, word: bytes) -> np.ndarray:
        return self.of_phrase((word,))


class _Prepared:
    """A template's words, their postings, and its phrases with their places."""

    def __init__(self, template: Template):
        self.label = template.label
        self.words = words(template.text)
        self.postings: dict[bytes, list[int]] = {}
        for at, word in enumerate(self.words):
            self.postings.setdefault(word, []).append(at)
        whole = Places(template.text)
        self.phrases = [(tuple(words(p)), whole.of_phrase(tuple(words(p)))) for p in template.phrases]
        if not self.phrases or not all(len(at) for _, at in self.phrases):
            raise ValueError(f"a phrase of the template {template.text[:40]!r} is not in its text")
        self.needed = frozenset(w for p, _ in self.phrases for w in p)


def near(places: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    """For each wanted place, whether one of the sorted places is at most ``slack`` away."""
    return np.searchsorted(places, wanted - slack, "left") < np.searchsorted(places, wanted + slack, "right")


class LicenseIndex:
    """Postings of all templates by word, with the words' inverse document frequencies.

    For every template whose phrase words are all in a file, the file's RARE highest-IDF words of that template are
    looked up. A place of a word and its posting give the place where the template would begin; beginnings on which at
    least half of the rare words agree, within ``slack``, are candidates. There each mandatory phrase must stand in its
    place, and COVERAGE of the template's words must, all within ``slack``.
    """

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float], base: dict[str, str], slack: int = SLACK, coverage: float = COVERAGE):
        self.templates = [_Prepared(t) for t in templates]
        self.idf = {w.encode(): value for w, value in idf.items()}
        self.base = {tuple(words(p)): label for p, label in base.items()}
        self.slack, self.coverage = slack, coverage

    def rare_words(self, template: _Prepared, present: frozenset[bytes]) -> list[bytes]:
        return sorted((w for w in template.postings if w in present), key=lambda w: (-self.idf.get(w, math.inf), w))[:RARE]

    def beginnings(self, template: _Prepared, places: Places) -> np.ndarray:
        """Places where the template may begin: rare words agree on them by their relative positions."""
        rare = self.rare_words(template, places.distinct)
        starts = [np.unique(np.concatenate([places.of_word(w) - q for q in template.postings[w]])) for w in rare]
        every = np.unique(np.concatenate(starts))
        votes = sum(near(s, every, self.slack).astype(np.int64) for s in starts)
        return every[2 * votes >= len(rare)]

    def best(self, template: _Prepared, places: Places) -> float:
        """The greatest share of the template's words in place where its phrases stand too; 0 if there is no such place."""
        begin = self.beginnings(template, places)
        for phrase, offsets in template.phrases:
            found = places.of_phrase(phrase)
            begin = begin[np.logical_or.reduce([near(found, begin + q, self.slack) for q in offsets])]
        if not begin.size:
            return 0.0
        covered = sum(near(places.of_word(w), begin + q, self.slack).astype(np.int64) for w, own in template.postings.items() for q in own)
        share = float(covered.max()) / len(template.words)
        return share if share >= self.coverage else 0.0

    def scan(self, text: str) -> tuple:
        places = Places(text)
        base, n, first, last = set(), 0, None, None
        for phrase, label in self.base.items():
            found = places.of_phrase(phrase)
            if found.size:
                base.add(label)
                n += found.size
                first = int(found[0]) if first is None else min(first, int(found[0]))
                last = int(found[-1]) if last is None else max(last, int(found[-1]))
        labels, score = set(base), BASE_SCORE if base else 0.0
        for template in self.templates:
            if places.distinct.issuperset(template.needed):
                share = self.best(template, places)
                if share:
                    labels.add(template.label)
                    score = max(score, share)
        return len(places.words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


class _Frequencies:
    """Rows (word, n): documents of one task that hold each word of the vocabulary, and all documents as a null word."""

    def __init__(self, vocabulary: frozenset[bytes]):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                counts.update(self.vocabulary.intersection(words(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in counts), None], pa.string()), pa.array([*counts.values(), n], pa.int64())], names=["word", "n"])


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, float]:
    """The IDF over all documents of every word of the templates; one row a word reaches the driver."""
    vocabulary = frozenset(w for t in templates for w in words(t.text))
    counted = docs.select(named(text).cast("string").alias("text")).mapInArrow(_Frequencies(vocabulary), "word string, n long")
    found = {r.word: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = found.get(None, 0)
    return {w.decode(): math.log((total + 1) / (found.get(w.decode(), 0) + 1)) for w in vocabulary}


def _scanner(shared) -> Callable[[], Callable[[str], tuple]]:
    return lambda: LicenseIndex(*shared.value).scan


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE_PHRASES, text: str = "text", slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to every row; no shuffle of rows.

    n_base counts all places of base phrases; first_word and last_word are the least and greatest index of such a place's
    first word, null if there is none. ``labels`` adds those of templates found; both label columns are distinct, sorted
    and comma-joined, empty if there are none. score is the greatest share of a found template's words in place,
    BASE_SCORE for base phrases alone, else 0.

    A null or empty text has no words. Rows stay one for one, repeated rows too; an empty table gives no rows. Columns of
    the seven names are replaced. IDFs are counted over the whole table first, which decides only which words are looked
    up first, and each text is read once more for the scan.
    """
    shared = docs.sparkSession.sparkContext.broadcast((templates, inverse_frequencies(docs, templates, text), base, slack, coverage))
    long, string = pa.int64(), pa.string()
    arrow = dict(zip(OUTPUT, [long, long, long, long, string, string, pa.float64()]))
    ddl = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    rows = without(docs, *OUTPUT)
    found = rows.select(F.struct(*[named(c) for c in rows.columns]).alias("doc"), text_function(_scanner(shared), arrow, ddl)(named(text)).alias("found"))
    return found.select("doc.*", "found.*")
