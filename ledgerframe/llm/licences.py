"""Licence scans: matching statistics against a generalised suffix automaton, chained into template spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerframe.llm.words import words

# Phrases that tell a licence by themselves, and the opening notices of public licences.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
#: Words of a match that can seed a chain, words between two seeds of a chain, share of a notice that labels a text.
SEED, GAP_WORDS, COVER = 4, 20, 0.5


class Span(NamedTuple):
    """A stretch of a text that a notice covers, by words from 0, ends not included; `share` is the covered part of the notice."""

    label: str
    notice: int
    first_word: int
    end_word: int
    template_first: int
    template_end: int
    share: float


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences.

    Each state stands for the word strings that end at the same places of the templates; `link` leads to the longest
    suffix that ends at more places. A state's places are its own and those of all states whose links lead to it: they
    stand side by side in one list, in the order of a walk down the links, so the list is as long as the templates.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, set[tuple[int, int]]] = {}
        for t, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                own.setdefault(last, set()).add((t, i))
        self.whole = []
        for sequence in sequences:
            v = 0
            for word in sequence:
                v = self.next[v][word]
            self.whole.append(v)
        below: list[list[int]] = [[] for _ in self.next]
        for v, above in enumerate(self.link[1:], 1):
            below[above].append(v)
        self._ends: list[tuple[int, int]] = []
        self._first, self._last, ahead = [0] * len(self.next), [0] * len(self.next), [(0, False)]
        while ahead:
            v, done = ahead.pop()
            if done:
                self._last[v] = len(self._ends)
                continue
            self._first[v] = len(self._ends)
            self._ends += sorted(own.get(v, ()))
            ahead.append((v, True))
            ahead += [(w, False) for w in below[v]]

    def places(self, v: int) -> list[tuple[int, int]]:
        """Every (template, end) of a state's strings."""
        return self._ends[self._first[v] : self._last[v]]

    def suffixes(self, wanted: dict[int, int]) -> list[list[int]]:
        """For each state: the templates of `wanted` (template: words) that are, as a whole, a suffix of its longest string."""
        found: list[list[int]] = [[] for _ in self.next]
        at: dict[int, list[int]] = {}
        for t in wanted:
            at.setdefault(self.whole[t], []).append(t)
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            found[v] = at.get(v, []) + found[self.link[v]]
        return found

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the strings of q that are one word longer than those of p."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """For each word: the state and length of the longest string that ends there and occurs in a template."""
        v = n = 0
        for word in sequence:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if word in self.next[v]:
                v, n = self.next[v][word], n + 1
            else:
                v = n = 0
            yield v, n


class Scanner:
    """Finds phrases and covered notices, (label, text) each, in a text's word hashes."""

    def __init__(self, phrases: tuple = PHRASES, notices: tuple = NOTICES):
        self.labels = [label for label, _ in (*phrases, *notices)]
        hashed = next(words([text for _, text in (*phrases, *notices)]))
        self.vocabulary = np.unique(np.concatenate(hashed))
        ids = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.sizes, self.phrases = [len(x) for x in ids], len(phrases)
        self.automaton = SuffixAutomaton(ids)
        self.whole = self.automaton.suffixes({t: self.sizes[t] for t in range(self.phrases)})
        self.wide = len(self.vocabulary) + 1  # the last number: words of no template
        self.pairs = np.unique([a * self.wide + b for x in ids for a, b in zip(x, x[1:])]).astype(np.int64)
        self.single = {x[0]: t for t, x in enumerate(ids[: self.phrases]) if len(x) == 1}

    def scan(self, hashes: np.ndarray) -> tuple[list[tuple[int, str]], list[Span]]:
        """(start, label) of every phrase's every place, and the best span of each notice that is covered by COVER at least."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))
        joined = np.zeros(max(len(ids) - 1, 0), dtype=bool)
        known = ids < self.wide - 1
        if len(both := np.flatnonzero(known[:-1] & known[1:])) and len(self.pairs):
            pair = ids[both] * self.wide + ids[both + 1]
            joined[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        found, seeds = [], []
        # A string of two words or more lies within a stretch of pairs that templates have.
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            steps = list(self.automaton.statistics(ids[start : end + 1].tolist()))
            for k, (v, n) in enumerate(steps):
                found += [(start + k - self.sizes[t] + 1, self.labels[t]) for t in self.whole[v] if n >= self.sizes[t] > 1]
                if n >= SEED and (k + 1 == len(steps) or steps[k + 1][1] != n + 1):
                    seeds += [(start + k - n + 1, place - n + 1, n, t) for t, place in self.automaton.places(v) if t >= self.phrases]
        for word, t in self.single.items():
            found += [(k, self.labels[t]) for k in np.flatnonzero(ids == word).tolist()]
        spans = []
        for t in sorted({s[3] for s in seeds}):
            words_covered, links = chain([s[:3] for s in seeds if s[3] == t])
            if (share := words_covered / self.sizes[t]) >= COVER:
                (x, y, _), (a, b, n) = links[0], links[-1]
                spans.append(Span(self.labels[t], t - self.phrases, x, a + n, y, b + n, share))
        return sorted(found), spans


def chain(seeds: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Most template words that seeds (text start, template start, words) cover in order, GAP_WORDS apart at most, and those seeds.

    A seed looks back on all seeds that can end within the gap before it: none starts further back than the gap and the
    longest seed, so their number depends on the templates and not on the text.
    """
    seeds = sorted(seeds)
    starts, reach = [s[0] for s in seeds], GAP_WORDS + max((s[2] for s in seeds), default=0)
    best: list[tuple[int, int]] = []  # words covered up to each seed, and the seed before it
    for i, (x, y, n) in enumerate(seeds):
        most = (n, -1)
        for j in range(bisect_left(starts, x - reach), i):
            a, b, m = seeds[j]
            over = max(0, a + m - x, b + m - y)  # words that both cover
            if y > b and x > a and x - (a + m) <= GAP_WORDS and over < n:
                most = max(most, (best[j][0] + n - over, j))
        best.append(most)
    if not best:
        return 0, []
    at, links = max(range(len(best)), key=lambda i: best[i][0]), []
    covered = best[at][0]
    while at >= 0:
        links.append(seeds[at])
        at = best[at][1]
    return covered, links[::-1]


@cache
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(phrases, notices)


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Licences in each row's whole text (doc_id, text), by phrases and notices of (label, text) each.

    One row per input row: doc_id, n_words, n_base (places of the phrases), first_word, last_word (smallest and
    largest start, null without a place), base_labels, labels (the phrases' and those of notices covered by COVER
    at least, distinct, sorted, comma-joined; empty without any), score (1 with a phrase, else the best notice's covered
    share, else 0), spans (the best stretch of each covered notice: label, notice, first_word, end_word,
    template_first, template_end, share). Null and empty texts have no word and no label; texts of any length are
    scanned whole. Rows that repeat and null ids are rows like others, other columns don't matter. No rows give no rows.
    """

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = scanner(phrases, notices)
        for batch in batches:
            rows = []
            for many in words(batch["text"].tolist()):
                for hashes in many:
                    found, spans = finder.scan(hashes)
                    base = {label for _, label in found}
                    score = 1.0 if base else max((s.share for s in spans), default=0.0)
                    first, last = (found[0][0], found[-1][0]) if found else (None, None)
                    labels = sorted(base | {s.label for s in spans})
                    rows.append((len(hashes), len(found), first, last, ",".join(sorted(base)), ",".join(labels), score, [s._asdict() for s in spans]))
            frame = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    spans = "array<struct<label string, notice int, first_word long, end_word long, template_first int, template_end int, share double>>"
    schema = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {spans}"
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(one, f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast("long"))
