"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words of every template. Streaming a text through it gives the matching
statistics: at each word, how long the longest run of template words that ends there is. Runs that cannot be
lengthened and are long enough are chained, in the order of text and template, into spans that cover a template.
Words that no template holds reset the automaton, so only runs of template words are streamed at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rastertable.llm.tables import documents, map_rows
from rastertable.llm.words import LETTERS, hashes, lower, split, utf8

#: Phrases whose every place is reported, with their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Published licence texts or notices, each cut to a well-known part (fixed values).
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
           "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
           "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
           "the following conditions",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
                  "may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
                  "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
                  "either express or implied",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are "
           "met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
           "the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
               "file you can obtain one at http mozilla org mpl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
           "above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
                 "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
}


class SuffixAutomaton:
    """States of all runs of the given sequences; each state knows where in which sequences its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((k, at + 1))
        for state in sorted(range(len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, above: int, word: int, ends: list) -> int:
        """The state that ``word`` leads to from ``above``, made to hold no longer runs than that step gives."""
        old = self.next[above][word]
        if self.length[old] == self.length[above] + 1:
            return old
        new = self._state(self.length[above] + 1, ends)
        self.next[new] = dict(self.next[old])
        self.link[new], self.link[old] = self.link[old], new
        while above >= 0 and self.next[above].get(word) == old:
            self.next[above][word] = new
            above = self.link[above]
        return new

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        new = self._state(self.length[last] + 1, ends)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, ends)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run ending at each word."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append((length, state))
        return out

    def ancestors(self, state: int, length: int):
        """The state and its suffixes, with the length of the run that each stands for."""
        while state > 0:
            yield state, min(length, self.length[state])
            state = self.link[state]


@dataclass
class _Chain:
    start: int
    stop: int
    at: int  # in the template, after the last match
    covered: int


@dataclass(frozen=True)
class Library:
    """Phrases and templates with their labels. Spans count from ``least`` words a match and ``cover`` of the template."""

    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    templates: tuple[tuple[str, str], ...] = tuple((text, label) for label, text in TEMPLATES.items())
    least: int = 4
    cover: float = 0.5
    gap: int = 12


@lru_cache(maxsize=4)
def _prepared(library: Library):
    texts = [t for t, _ in library.phrases + library.templates]
    words = [t.encode().split() for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
    data = np.frombuffer(b" ".join(vocabulary), np.uint8)
    own = split(data, np.array([0, len(data)]), LETTERS)
    h = hashes(data, own.start, own.stop)
    order = np.argsort(h)
    sequences = [[vocabulary[w] for w in t] for t in words]
    pairs = np.zeros((len(vocabulary), len(vocabulary)), bool)
    for s in sequences:
        pairs[s[:-1], s[1:]] = True
    return h[order], order.astype(np.int64), pairs, SuffixAutomaton(sequences), [len(s) for s in sequences]


def find(column: pa.Array, library: Library) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
    """Of each row: its number of words, the places of phrases, the covered spans of templates."""
    known, ids, pairs, automaton, sizes = _prepared(library)
    data, at = utf8(column)
    data = lower(data)
    words = split(data, at, LETTERS)
    rows = len(column)
    places: list[list[dict]] = [[] for _ in range(rows)]
    spans: list[list[dict]] = [[] for _ in range(rows)]
    if not len(words.start):
        return np.diff(words.first), places, spans
    h = hashes(data, words.start, words.stop)
    where = np.minimum(np.searchsorted(known, h), len(known) - 1)
    word = np.where(known[where] == h, ids[where], -1)
    row = words.row
    # a word and the next one stand side by side in a template
    paired = (word[:-1] >= 0) & (word[1:] >= 0) & (row[:-1] == row[1:])
    paired[paired] = pairs[word[:-1][paired], word[1:][paired]]
    begins = np.flatnonzero(paired & ~np.concatenate([[False], paired[:-1]]))
    ends = np.flatnonzero(paired & ~np.concatenate([paired[1:], [False]])) + 2
    long: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        r, base = int(row[a]), a - int(words.first[row[a]])
        stats = automaton.statistics(word[a:b].tolist())
        for i, (length, state) in enumerate(stats):
            stop = base + i + 1
            for s, n in automaton.ancestors(state, length):
                for k, end in automaton.ends[s]:
                    if k < len(library.phrases) and end == sizes[k] and n >= end and (k, end) not in _below(automaton, s, end):
                        places[r].append({"label": library.phrases[k][1], "start": stop - end, "end": stop})
            ended = i + 1 == len(stats) or stats[i + 1][0] != length + 1
            if ended and length >= library.least:
                long.setdefault(r, []).append((stop - length, length, state))
    for r, matches in long.items():
        spans[r] = _chains(matches, automaton, sizes, library)
    for own in places:
        own.sort(key=lambda p: (p["start"], p["end"]))
    return np.diff(words.first), places, spans


def _below(automaton: SuffixAutomaton, state: int, length: int) -> list[tuple[int, int]]:
    """Ends of the suffix of this state, if that already stands for runs of ``length``; they are reported there."""
    link = automaton.link[state]
    return automaton.ends[link] if link > 0 and automaton.length[link] >= length else []


def _chains(matches: list[tuple[int, int, int]], automaton: SuffixAutomaton, sizes: list[int], library: Library) -> list[dict]:
    """Spans of templates: matches in the order of text and template, with small gaps in both."""
    first = len(library.phrases)
    open_, out = {}, []

    def close(k: int) -> None:
        chain = open_.pop(k, None)
        if chain is not None and chain.covered >= library.cover * sizes[k]:
            out.append({"label": library.templates[k - first][1], "start": chain.start, "end": chain.stop,
                        "share": min(1.0, chain.covered / sizes[k])})

    for start, length, state in sorted(matches):
        for k, end in automaton.ends[state]:
            if k < first:
                continue
            begin, chain = end - length, open_.get(k)
            if chain is not None and start - chain.stop <= library.gap and end > chain.at and begin - chain.at <= library.gap:
                chain.covered += min(length, end - chain.at)
                chain.stop, chain.at = max(chain.stop, start + length), end
                continue
            if chain is not None and start < chain.stop:
                continue  # another place of the same run in the template
            close(k)
            open_[k] = _Chain(start, start + length, end, length)
    for k in list(open_):
        close(k)
    return sorted(out, key=lambda s: (s["start"], s["end"], s["label"]))


def scan(docs: DataFrame, library: Library | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` of phrases and ``spans`` of templates (label, start, end in words; share) of every row.

    Null and empty texts have no words; null and repeated doc_ids stay as they are; an empty table gives an empty table.
    """
    library = library or Library()

    def run(batch: pa.RecordBatch) -> dict:
        n, places, spans = find(batch.column(1), library)
        return {"doc_id": batch.column(0), "n_words": n, "places": places, "spans": spans}

    return map_rows(documents(docs), run, "doc_id long, n_words long, places array<struct<label string, start long, end long>>, "
                                          "spans array<struct<label string, start long, end long, share double>>")
