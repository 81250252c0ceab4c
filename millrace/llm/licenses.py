"""Licence scan by a generalised suffix automaton of licence words (operator 12).

All templates and phrases form one suffix automaton over word numbers: a state stands for the runs of words that end
at the same places of the templates. A text is streamed through it once. After each word the state and a length are
the longest run ending there that stands in some template (matching statistics). Where a run cannot be made longer it
is a match; matches of at least ``LEAST`` words are chained for each template: in rising order in the text and in the
template, at most ``GAP`` words apart, each counting the template words it newly covers. A chain that covers ``COVERED``
of its template is a span with the template's label. Phrases (the base) and templates of fewer than ``LEAST`` words are
found at each place where all their words stand: the states of whole phrases are known by the links of the automaton.

Scale: one pass over each text, no shuffle. The automaton is built once in each task from the templates, whose size
is that of the parameter. A chain looks back only over matches that end within a gap, so its cost grows with the text.

Defined results: null texts count as empty; texts without words have no spans and score 0. The score is the largest
share of a template or phrase that a chain covers, 1 where one stands whole. Each input row gives one row, repeated
rows too; a null id is kept. Of chains that share a match the one that covers more is taken, of equal ones the one
that ends first. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

#: Words of a match, words between two matches of a chain, share of a template that makes a span.
LEAST, GAP, COVERED = 4, 24, 0.75
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The base: phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label: notices that name a licence, and the wording of short licences (fixed values, public texts).
TEMPLATES = {
    "mit": [
        "the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "gpl-2.0": ["the GNU General Public License, version 2"],
    "gpl-3.0": ["the GNU General Public License, version 3"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "public-domain": ["dedicated to the public domain", "This is free and unencumbered software released into the public domain."],
}


def words_of(text: str) -> list[bytes]:
    """The words, A-Z in lower case."""
    return WORD.findall(text.encode().lower())


class Automaton:
    """Suffix automaton of several lists of word numbers.

    ``places`` of a state are the ends of its runs in the templates, for runs of at least ``least`` words; ``whole``
    lists, longest first, the templates whose whole text ends a run of the state.
    """

    def __init__(self, templates: list[list[int]], least: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        finals = []
        for t, ids in enumerate(templates):
            state = 0
            for at, w in enumerate(ids):
                state = self.extended(state, w)
                ends[state].append((t, at))
            finals.append(state)
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        own = defaultdict(list)
        for t, state in enumerate(finals):
            if templates[t]:
                own[state].append((len(templates[t]), t))
        self.places: list[list[tuple[int, int]]] = [list(ends[s]) for s in range(len(self.next))]
        rising = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in rising:
            self.whole[s] = sorted(own[s], reverse=True) + self.whole[self.link[s]]
        for s in reversed(rising):
            if self.length[self.link[s]] >= least:
                self.places[self.link[s]] += self.places[s]

    def state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def split(self, state: int, w: int) -> int:
        """The state of exactly one word more than ``state`` after ``w``; a longer one is divided."""
        to = self.next[state][w]
        if self.length[to] == self.length[state] + 1:
            return to
        twin = self.state(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = twin
        while state >= 0 and self.next[state].get(w) == to:
            self.next[state][w] = twin
            state = self.link[state]
        return twin

    def extended(self, last: int, w: int) -> int:
        """The state of the template read so far, ``last``, with one more word."""
        if w in self.next[last]:
            return self.split(last, w)
        fresh = self.state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = fresh
            at = self.link[at]
        if at >= 0:
            self.link[fresh] = self.split(at, w)
        return fresh

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest run ending there that a template holds; -1 is in none."""
        follow, link, length = self.next, self.link, self.length
        state = size = 0
        for w in ids:
            if w < 0:
                state = size = 0
            else:
                while w not in follow[state]:
                    state = link[state]
                    size = length[state]
                state = follow[state][w]
                size += 1
            yield state, size


class Scanner:
    """Automaton, labels and the chaining of matches."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], least: int = LEAST, gap: int = GAP, covered: float = COVERED):
        self.least, self.gap, self.covered = least, gap, covered
        self.labels = [*phrases.values(), *(label for label, texts in templates.items() for _ in texts)]
        self.base = len(phrases)
        texts = [words_of(t) for t in [*phrases, *(t for own in templates.values() for t in own)]]
        self.numbers: dict[bytes, int] = {}
        ids = [[self.numbers.setdefault(w, len(self.numbers)) for w in words] for words in texts]
        self.sizes = [len(i) for i in ids]
        self.automaton = Automaton(ids, least)

    def scan(self, text: str) -> tuple[int, list[tuple[bool, str, int, int, float]], float]:
        """Words; spans (base, label, first word, last word, share) in order; score."""
        words = words_of(text)
        number = self.numbers.get
        ids = [number(w, -1) for w in words]
        spans, matches = [], defaultdict(list)
        held, held_state, at = 0, 0, -1
        whole, places = self.automaton.whole, self.automaton.places
        for at, (state, size) in enumerate(self.automaton.statistics(ids)):
            if size <= held and held >= self.least:
                for t, end in places[held_state]:
                    matches[t].append((at - 1, end, held))
            if size and whole[state]:
                for length, t in whole[state]:
                    if length <= size and (t < self.base or length < self.least):
                        spans.append((t < self.base, self.labels[t], at - length + 1, at, 1.0))
            held, held_state = size, state
        if held >= self.least:
            for t, end in places[held_state]:
                matches[t].append((at, end, held))
        score = 1.0 if spans else 0.0
        for t, own in matches.items():
            if t < self.base or self.sizes[t] < self.least:
                continue
            for first, last, new in self.chains(own):
                share = min(1.0, new / self.sizes[t])
                score = max(score, share)
                if share >= self.covered:
                    spans.append((False, self.labels[t], first, last, share))
        return len(words), sorted(spans, key=lambda s: (s[2], s[3], not s[0], s[1])), score

    def chains(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """First word, last word and covered words of the chains of one template, best first, no match in two of them.

        A match is its end in the text, its end in the template and its length; they come by their end in the text.
        """
        best, before = [], []
        for j, (end, to, size) in enumerate(matches):
            new, link = size, -1
            k = j - 1
            while k >= 0 and matches[k][0] >= end - size - self.gap:
                e, t, _ = matches[k]
                more = min(size, to - t, end - e)
                if more > 0 and best[k] + more > new:
                    new, link = best[k] + more, k
                k -= 1
            best.append(new)
            before.append(link)
        used = [False] * len(matches)
        for j in sorted(range(len(matches)), key=lambda j: (-best[j], matches[j][0])):
            path, k = [], j
            while k >= 0 and not used[k]:
                path.append(k)
                k = before[k]
            # a chain that runs into a better one is a part of that one
            if k < 0:
                end, _, size = matches[path[-1]]
                yield end - size + 1, matches[j][0], best[j]
            for k in path:
                used[k] = True


SPAN = "struct<base: boolean, label: string, first: long, last: long, share: double>"


def scan(df: DataFrame, key: Column, text: Column, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, **limits) -> DataFrame:
    """key, n_words, spans (by place), score of every row."""
    span_type = pa.list_(pa.struct([("base", pa.bool_()), ("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

    def make():
        scanner = Scanner(phrases, templates, **limits)

        def step(keys: list, texts: list[str | None]):
            got = [scanner.scan(t or "") for t in texts]
            names = ("base", "label", "first", "last", "share")
            spans = pa.array([[dict(zip(names, s, strict=True)) for s in found] for _, found, _ in got], span_type)
            return keys, pa.array(np.array([n for n, _, _ in got], np.int64)), spans, pa.array(np.array([s for _, _, s in got], np.float64))

        return step

    return map_batches(df, [key.cast("long"), text], make, f"key long, n_words long, spans array<{SPAN}>, score double")
