"""Licence scans with a generalised suffix automaton over the words of licence notices."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm.automaton import SuffixAutomaton
from trustframe.llm.common import ALPHANUMERIC, as_bytes, text_slices, word_hashes

#: Phrases that are counted wherever they stand.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Notices of well-known licences.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
               "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
               "CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
            "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
            "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
            "PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
            "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
            "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>")


class State(NamedTuple):
    """Frozen state of the automaton: ``base`` has (words, label) of the phrases that end here."""

    next: dict[int, int]
    link: int
    length: int
    base: tuple[tuple[int, str], ...]


class Automaton(SuffixAutomaton):
    """Suffix automaton of the words of notices and phrases; a state knows where in which sequence its words end."""

    def __init__(self, notices: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]):
        texts = [*notices, *base]
        hashes, bounds = word_hashes([text.encode() for _, text in texts], ALPHANUMERIC, True)
        self.words, ids = np.unique(hashes, return_inverse=True)
        self.labels = [label for label, _ in texts]
        self.sequences = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
        super().__init__()
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for number, sequence in enumerate(self.sequences):
            for at, state in enumerate(self.add(sequence)):
                ends[state].add((number, at))
        for state in self.longest_first():
            ends[self.link[state]] |= ends[state]
        self.ends = [tuple(sorted(ends[state])) for state in range(len(self.length))]
        marks: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        own = {self.state(self.sequences[len(notices) + k]): (len(self.sequences[len(notices) + k]), label)
               for k, (label, _) in enumerate(base)}
        for state in reversed(self.longest_first()):
            marks[state] = marks[self.link[state]] + ((own[state],) if state in own else ())
        self.states = [State(*x) for x in zip(self.next, self.link, self.length, marks, strict=True)]

    def read(self, places: list[int], words: list[int], shortest: int) -> tuple[list, list]:
        """Matching statistics of known words at the given places: base phrases (start, label), and the matches
        that cannot be made longer (first place, words, state)."""
        states, found, matches = self.states, [], []
        state = length = 0
        before = -2
        for place, word in zip(places, words, strict=True):
            if place != before + 1:
                if length >= shortest:
                    matches.append((before - length + 1, length, state))
                state = length = 0
            elif word not in states[state].next and length >= shortest:
                matches.append((before - length + 1, length, state))
            while state and word not in states[state].next:
                state = states[state].link
                length = states[state].length
            if word in states[state].next:
                state = states[state].next[word]
                length += 1
                for n, label in states[state].base:
                    if n <= length:
                        found.append((place - n + 1, label))
            before = place
        if length >= shortest:
            matches.append((before - length + 1, length, state))
        return found, matches

    def chains(self, matches: list[tuple[int, int, int]], gap: int) -> list[tuple[str, int, int, float]]:
        """Matches chained in order of text and notice, at most ``gap`` words apart: label, first and last word,
        and the share of the notice that is covered."""
        open_: dict[int, list[int]] = {}  # notice: first place, last place, last position in it, words covered
        done = []

        def close(number: int) -> None:
            first, last, _, covered = open_.pop(number)
            done.append((self.labels[number], first, last, covered / len(self.sequences[number])))

        for place, n, state in matches:
            for number, end in self.ends[state]:
                begin, last = end - n + 1, place + n - 1
                chain = open_.get(number)
                if chain and (place - chain[1] - 1 > gap or end <= chain[2]):
                    if n <= chain[3] and place - chain[1] - 1 <= gap:
                        continue  # a shorter match out of order doesn't break a chain
                    close(number)
                    chain = None
                if chain:
                    chain[3] += end - max(begin - 1, chain[2])
                    chain[1], chain[2] = last, end
                else:
                    open_[number] = [place, last, end, n]
        for number in list(open_):
            close(number)
        return done


@functools.cache
def _automaton(notices: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(notices, base)


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES,
         base: tuple[tuple[str, str], ...] = BASE, shortest: int = 3, gap: int = 6, least: float = 0.8) -> DataFrame:
    """Licence notices in each text: counts and places of the base phrases, labels, score and covered spans.

    All words are streamed through one automaton, some texts at a time. Matches of at least ``shortest`` words are chained when they
    follow each other in the text and in the notice, at most ``gap`` words apart; a chain that covers ``least`` of a
    notice is a span and gives its label. The score is the largest covered share of any notice, and 1 where a base
    phrase stands. Null and empty texts have no words, no labels and score 0. The automaton's size is that of the
    notices, which are parameters. Repeated rows give repeated results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(notices, base)
        for batch in batches:
            for a, b in text_slices(batch["text"], 1 << 20):
                out: list[list] = [[] for _ in range(8)]
                hashes, bounds = word_hashes(as_bytes(batch["text"].slice(a, b - a)), ALPHANUMERIC, True)
                at = np.minimum(np.searchsorted(automaton.words, hashes), len(automaton.words) - 1)
                known = automaton.words[at] == hashes
                for begin, end in zip(bounds, bounds[1:], strict=False):
                    places = np.flatnonzero(known[begin:end])
                    found, matches = automaton.read(places.tolist(), at[begin:end][places].tolist(), shortest)
                    spans = automaton.chains(matches, gap)
                    kept = [x for x in spans if x[3] >= least]
                    own = {label for _, label in found}
                    values = (int(end - begin), len(found), min(found)[0] if found else None,
                              max(found)[0] if found else None, ",".join(sorted(own)),
                              ",".join(sorted(own | {x[0] for x in kept})),
                              1.0 if own else min(1.0, max((x[3] for x in spans), default=0.0)), kept)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                out[7] = [[dict(zip(("label", "first", "last", "covered"), x, strict=True)) for x in y] for y in out[7]]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                    [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *map(pa.array, out, kinds)],
                                                 names=[x.split()[0] for x in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)
