"""Licence scan: matching statistics of texts against a suffix automaton of licence templates.

All templates go into one generalised suffix automaton over words. A text streams through it once; at every
word the automaton gives the longest template passage that ends there. Passages that cannot be longer are
chained along a template, and a chain that covers enough of the template is a span with the template's label.
A phrase is found wherever the longest passage ends with it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.common import WORD_BYTES, map_texts

# The phrases that count by themselves, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Passages of public licences and of the notices that name them, with their labels.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
    ],
}


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII digits, letters (A-Z lower-cased) and everything beyond ASCII."""
    return [] if text is None else text.encode().translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: Per state: {sequence: last word's position of one occurrence}
        self.ends: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            state = 0
            for position, word in enumerate(sequence):
                state = self._append(state, word)
                self.ends[state].setdefault(number, position)
        # What ends at a state also ends at the states of its suffixes.
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for number, position in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, position)

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, origin: int, word: int, target: int) -> int:
        """The part of ``target`` that is reached over ``origin``'s strings, as a state of its own."""
        if self.length[target] == self.length[origin] + 1:
            return target
        part = self._new(self.length[origin] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while origin != -1 and self.next[origin].get(word) == target:
            self.next[origin][word] = part
            origin = self.link[origin]
        return part

    def _append(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        state = self._new(self.length[last] + 1, {}, 0)
        origin = last
        while origin != -1 and word not in self.next[origin]:
            self.next[origin][word] = state
            origin = self.link[origin]
        if origin != -1:
            self.link[state] = self._split(origin, word, self.next[origin][word])
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest passage that ends with the next word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0


class Scanner:
    """Phrases and templates ready to be looked for; travels to the tasks."""

    def __init__(
        self,
        templates: Mapping[str, Sequence[str]],
        phrases: Mapping[str, str],
        min_match: int,
        max_gap: int,
        min_cover: float,
    ):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        listed = [(label, words_of(t), False) for label, texts in templates.items() for t in texts]
        listed += [(label, words_of(p), True) for p, label in phrases.items()]
        listed = [x for x in listed if x[1]]
        self.labels = [label for label, _, _ in listed]
        self.sizes = [len(words) for _, words, _ in listed]
        self.phrases = [n for n, (_, _, whole) in enumerate(listed) if whole]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, words, _ in listed for w in words))}
        sequences = [[self.number[w] for w in words] for _, words, _ in listed]
        self.automaton = Automaton(sequences)
        # Pairs of words that follow each other somewhere; a last row and column for all other words.
        size = len(self.number)
        self.pairs = np.zeros((size + 1, size + 1), bool)
        for s in sequences:
            self.pairs[s[:-1], s[1:]] = True
        self.shortest = min([min_match, *(self.sizes[n] for n in self.phrases)])
        # States at which a phrase ends: itself, and those with the phrase as a suffix.
        self.phrase_ends: dict[int, list[int]] = {}
        whole = {}
        for n in self.phrases:
            state = length = 0
            for word in sequences[n]:
                state, length = self.automaton.step(state, length, word)
            whole.setdefault(state, []).append(n)
        for state in range(len(self.automaton.link)):
            up, found = state, []
            while up > 0:
                found += whole.get(up, [])
                up = self.automaton.link[up]
            if found:
                self.phrase_ends[state] = found

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words outside of which no passage of ``shortest`` words can lie."""
        if self.shortest <= 1:
            return [(0, len(ids))]
        good = np.concatenate([[False], self.pairs[ids[:-1], ids[1:]], [False]])
        edges = np.flatnonzero(good[1:] != good[:-1]).reshape(-1, 2)
        # Pairs edges[0]..edges[1]-1 hold, so the words are edges[0]..edges[1].
        return [(a, b + 1) for a, b in edges.tolist() if b - a + 1 >= self.shortest]

    def scan(self, words: list[bytes]) -> tuple[list, list]:
        """Places of phrases as (phrase, first word), and template spans as (label, first, end, share)."""
        get, other = self.number.get, len(self.number)
        ids = np.fromiter((get(w, other) for w in words), np.int64, len(words))
        hits, segments, step = [], {}, self.automaton.step
        if len(words) < self.shortest:
            return hits, []
        for start, end in self.stretches(ids):
            state = length = 0
            for at, word in enumerate(ids[start:end].tolist(), start):
                before, was = state, length
                state, length = step(state, length, word)
                if length != was + 1 and was >= self.min_match:
                    self._note(segments, before, was, at)
                for n in self.phrase_ends.get(state, ()):
                    if length >= self.sizes[n]:
                        hits.append((n, at + 1 - self.sizes[n]))
            if length >= self.min_match:
                self._note(segments, state, length, end)
        return hits, [span for n, found in segments.items() for span in self._chains(n, found)]

    def _note(self, segments: dict, state: int, length: int, end: int) -> None:
        for n, position in self.automaton.ends[state].items():
            segments.setdefault(n, []).append((end - length, position + 1 - length, length))

    def _chains(self, n: int, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Greedy chains in text order: each passage goes on later in text and template, within the gap."""
        chains: list[list] = []  # first word, end in text, end in template, words covered
        for at, position, length in sorted(found):
            for chain in reversed(chains):
                text_gap, own_gap = at - chain[1], position - chain[2]
                if -length < text_gap <= self.max_gap and -length < own_gap <= self.max_gap:
                    cut = max(0, -text_gap, -own_gap)
                    chain[3] += length - cut
                    chain[1], chain[2] = at + length, position + length
                    break
                if text_gap > self.max_gap:
                    chains.append([at, at + length, position + length, length])
                    break
            else:
                chains.append([at, at + length, position + length, length])
        return [
            (self.labels[n], first, end, min(1.0, covered / self.sizes[n]))
            for first, end, _, covered in chains
            if covered >= self.min_cover * self.sizes[n]
        ]


SPANS = "array<struct<label:string,first_word:bigint,end_word:bigint,share:double>>"


def scan_licenses(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    min_match: int = 4,
    max_gap: int = 8,
    min_cover: float = 0.5,
) -> DataFrame:
    """One row per row of ``df``: columns ``keep`` and what was found in the whole text.

    n_words, n_base (places of phrases, overlapping ones too), first_word and last_word (their smallest and
    largest start, words from 0, else null), base_labels and labels (distinct, sorted), spans (label, first
    word, end word, share of the template covered; at least ``min_cover``, from passages of ``min_match``
    words or more with at most ``max_gap`` words between them), score (largest share; 1 for a phrase).

    A null or empty text has no words: counts 0, no labels, score 0. Repeated rows are scanned each; a null in
    ``keep`` is kept; an empty table gives an empty result. Other columns are not looked at.
    """
    scanner = Scanner(templates, phrases, min_match, max_gap, min_cover)
    added = T._parse_datatype_string(
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        f"base_labels array<string>, labels array<string>, spans {SPANS}, score double"
    )
    names = ["label", "first_word", "end_word", "share"]

    def work(texts):
        rows = []
        for value in texts:
            words = words_of(value)
            hits, spans = scanner.scan(words)
            starts = [at for _, at in hits]
            base = sorted({scanner.labels[n] for n, _ in hits})
            whole = [
                (scanner.labels[n], at, at + scanner.sizes[n], 1.0) for n, at in hits
            ]
            spans = sorted({*spans, *whole}, key=lambda s: (s[1], s[2], s[0], s[3]))
            rows.append(
                (
                    len(words),
                    len(hits),
                    min(starts, default=None),
                    max(starts, default=None),
                    base,
                    sorted({s[0] for s in spans}),
                    [dict(zip(names, s)) for s in spans],
                    max((s[3] for s in spans), default=0.0),
                )
            )
        return list(zip(*rows))

    return map_texts(df, text, keep, added, work)
