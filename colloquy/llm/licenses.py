"""Licence scans with a generalised suffix automaton.

All templates (licence texts, notices, one-line grants, and the phrases that are looked for as
they stand) make one suffix automaton of their words. A text is streamed through it, and at
each word it tells how many words up to there stand in some template, and where: the matching
statistics. Matches that can't be made longer and have enough words are chained per template,
in the order of both, over small gaps; a chain is a span of the text, with the share of the
template that it covers. Spans that cover enough give their template's label.

The step of the automaton is closed over its suffix links and kept as a table (state, word) ->
(state, most words kept), so runs of known words go through it side by side. Words that no
template has end a run. Long runs are cut, with as many words before each cut as the longest
template has, which changes nothing, since no match is longer. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .quality import _rows
from .shared import lanes, lower_words, pick

#: Words of a match that a chain may use; words that a chain may leave out between two matches.
MIN_MATCH, MAX_GAP = 4, 8
#: Share of a template that a span must cover for its label.
MIN_COVERED = 0.75
#: Words of a run that go through the automaton together.
RUN_WORDS = 1024

# Phrases, which count where they stand whole, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Public licence texts, notices and grants, and their labels.
TEMPLATES = (
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit-grant"),
    ("Licensed under CC BY 4.0.", "cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0-1.0"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit-text",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl-3.0",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl-2.0",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
)


@dataclass
class State:
    """Strings of words that end at the same places: `ends` are (template, last word); `length` words are the longest."""

    length: int
    link: int = -1
    step: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)


def _words_of(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    spaced, begin, end, _ = lower_words(raw, np.array([0]), np.array([len(raw)]))
    return [spaced[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]


def suffix_automaton(texts: list[list[int]]) -> list[State]:
    """The states of all substrings of the texts; state 0 is the empty one."""
    states = [State(0)]

    def split(at: int, symbol: int) -> int:
        """The state of at's longest string and symbol behind it, taken out of the state that holds longer ones too."""
        old = states[at].step[symbol]
        if states[old].length == states[at].length + 1:
            return old
        states.append(State(states[at].length + 1, states[old].link, dict(states[old].step)))
        new = states[old].link = len(states) - 1
        while at >= 0 and states[at].step.get(symbol) == old:
            states[at].step[symbol], at = new, states[at].link
        return new

    def longer(last: int, symbol: int) -> int:
        """The state of last's longest string with symbol behind it."""
        if symbol in states[last].step:
            return split(last, symbol)
        states.append(State(states[last].length + 1))
        new, at = len(states) - 1, last
        while at >= 0 and symbol not in states[at].step:
            states[at].step[symbol], at = new, states[at].link
        states[new].link = split(at, symbol) if at >= 0 else 0
        return new

    for text in texts:
        last = 0
        for symbol in text:
            last = longer(last, symbol)
    for t, text in enumerate(texts):
        at = 0
        for i, symbol in enumerate(text):
            at = states[at].step[symbol]
            states[at].ends.append((t, i))
    for state in sorted(states[1:], key=lambda s: -s.length):
        states[state.link].ends += state.ends
    states[0].ends = []
    return states


class Templates:
    """Phrases and templates as one automaton, in the form in which texts are run through it."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.labels = [label for _, label in (*phrases, *templates)]
        self.n_phrases = len(phrases)
        words = [_words_of(text) for text, _ in (*phrases, *templates)]
        if not all(words):
            raise ValueError("a phrase or template has no word")
        known = sorted({w for text in words for w in text})
        number = {w: i + 1 for i, w in enumerate(known)}
        self.lengths = [len(text) for text in words]
        self.longest = max(self.lengths)
        size = np.array([len(w) for w in known])
        hashes = lanes()[0].segments(np.frombuffer(b"".join(known), np.uint8), np.cumsum(size) - size, size)
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.longest_word = hashes[order], (order + 1).astype(np.int32), int(size.max())
        texts = [[number[w] for w in text] for text in words]
        states = suffix_automaton(texts)
        # Word 0 is any that no template has.
        self.next = np.zeros((len(states), len(known) + 1), np.int32)
        self.most = np.full(self.next.shape, -1, np.int32)
        for i in sorted(range(len(states)), key=lambda i: states[i].length):
            if i:
                self.next[i], self.most[i] = self.next[states[i].link], self.most[states[i].link]
            for symbol, to in states[i].step.items():
                self.next[i, symbol], self.most[i, symbol] = to, states[i].length
        # Which phrases the longest string of a state ends with.
        self.phrase = np.zeros((self.n_phrases, len(states)), bool)
        self.ends = [[(t, e) for t, e in s.ends if t >= self.n_phrases] for s in states]
        for p in range(self.n_phrases):
            for i, s in enumerate(states):
                self.phrase[p, i] = s.length >= self.lengths[p] and any(self._ends_with(texts, end, texts[p]) for end in s.ends[:1])

    @staticmethod
    def _ends_with(texts, end, phrase) -> bool:
        t, e = end
        return e + 1 >= len(phrase) and texts[t][e + 1 - len(phrase) : e + 1] == phrase

    def numbers_of(self, spaced, begin, end) -> np.ndarray:
        """The numbers of words; 0 where no template has one."""
        out, size = np.zeros(len(begin), np.int32), end - begin
        at = np.flatnonzero(size <= self.longest_word)
        h = lanes()[0].segments(spaced, begin[at], size[at])
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out[at] = np.where(self.hashes[place] == h, self.numbers[place], 0)
        return out

    def statistics(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and length of the longest match that ends at each word; matches stay inside a row."""
        state, length = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        known = words > 0
        edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (row[1:] != row[:-1]), True]) if len(words) else np.zeros(1, np.int64)
        first, last = edge[:-1], edge[1:]
        first, last = first[known[first]], last[known[first]]
        # Long runs in parts, each with the words before it that a match may reach back to.
        parts = -(-(last - first) // RUN_WORDS)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        own = np.repeat(first, parts) + k * RUN_WORDS
        begin = np.maximum(np.repeat(first, parts), own - self.longest)
        end = np.minimum(np.repeat(last, parts), own + RUN_WORDS)
        order = np.argsort(begin - end, kind="stable")
        own, begin, n = own[order], begin[order], (end - begin)[order]
        at, have = np.zeros(len(n), np.int32), np.zeros(len(n), np.int32)
        active = len(n)
        for i in range(int(n[0]) if len(n) else 0):
            active = int(np.searchsorted(-n[:active], -i))  # parts of more than i words
            place = begin[:active] + i
            word = words[place]
            have[:active] = np.minimum(have[:active], self.most[at[:active], word]) + 1
            at[:active] = self.next[at[:active], word]
            put = place >= own[:active]
            state[place[put]], length[place[put]] = at[:active][put], have[:active][put]
        return state, length

    def places(self, state: np.ndarray, length: np.ndarray):
        """(phrase, last word) of all places where phrases stand."""
        for p in range(self.n_phrases):
            yield p, np.flatnonzero(self.phrase[p][state] & (length >= self.lengths[p]))

    def spans(self, state: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, word behind the last, covered words) of one row's chains; those of a template don't overlap."""
        following = np.r_[length[1:], 0]
        matches: dict[int, list] = {}
        for i in np.flatnonzero((length >= MIN_MATCH) & (following != length + 1)).tolist():
            for t, e in self.ends[state[i]]:
                matches.setdefault(t, []).append((i, e, int(length[i])))
        out = []
        for t, found in matches.items():
            out += [(t, *span) for span in _chains(found)]
        return sorted(out)


def _chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chains of matches (last word in the text, in the template, words), which go on in both: (first word, word behind the last, covered words).

    Only matches that end MAX_GAP words before another at most can come before it, so the work follows the
    number of matches. Of chains that overlap the one that covers most is taken.
    """
    found = sorted(found)
    best, before, first, low = [], [], [], 0
    for j, (i, e, n) in enumerate(found):
        while found[low][0] < i - n - MAX_GAP:
            low += 1
        most, back = n, -1
        for k in range(low, j):
            ki, ke, _ = found[k]
            if ki < i and ke < e and e - n - ke <= MAX_GAP:
                overlap = max(0, ki - (i - n), ke - (e - n))
                if best[k] + n - overlap > most:
                    most, back = best[k] + n - overlap, k
        best.append(most)
        before.append(back)
        first.append(first[back] if back >= 0 else i - n + 1)
    # Most covered first; a chain that shares words with one taken already goes.
    starts, taken = [], []
    for j in sorted(range(len(found)), key=lambda j: (-best[j], first[j])):
        a, b, n = first[j], found[j][0] + 1, best[j]
        at = bisect_right(starts, a)
        if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
            continue
        starts.insert(at, a)
        taken.insert(at, (a, b, n))
    return taken


def _read(templates: Templates, batch):
    """The numbers of all words of a batch, and each row's first word and end."""
    numbers, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, data, starts, ends in _rows(batch):
        spaced, begin, end, row = lower_words(data, starts, ends)
        numbers.append(templates.numbers_of(spaced, begin, end))
        rows.append(i + row)
    words, row = np.concatenate(numbers), np.concatenate(rows)
    return words, row, np.searchsorted(row, np.arange(batch.num_rows + 1))


def _template_spans(templates: Templates, state, length, bounds):
    """(row, spans) of the rows that have any."""
    rows = np.unique(np.searchsorted(bounds, np.flatnonzero(length >= MIN_MATCH), "right") - 1)
    for r in rows.tolist():
        a, b = bounds[r], bounds[r + 1]
        found = templates.spans(state[a:b], length[a:b])
        if found:
            yield r, found


def licence_spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, template, label, first_word, end_word, covered (words) and share of each span of a document that a template covers.

    Words are counted from 0, end_word is the word behind the last. Spans of one template don't overlap, those of
    different ones may. Null and empty texts have none; rows alike have the same ones each.
    """
    rows, known = pick(docs, "doc_id", "text"), Templates(phrases, templates)
    id_type = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])

    def scan(batches):
        for batch in batches:
            words, row, bounds = _read(known, batch)
            state, length = known.statistics(words, row)
            out = [(r, *s) for r, found in _template_spans(known, state, length, bounds) for s in found]
            at, t, a, b, n = (np.array(c, np.int64) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 5
            share = n / np.array(known.lengths)[t]
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array((t - known.n_phrases).astype(np.int32)), pa.array([known.labels[x] for x in t.tolist()], pa.string()), *(pa.array(x) for x in (a, b, n, share))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(scan, f"doc_id {id_type.simpleString()}, template int, label string, first_word long, end_word long, covered long, share double")


def scan_licences(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document.

    n_base counts the places of phrases, first_word and last_word are the first words of the first and the last one,
    from 0, null without any. labels are those of phrases and of the templates that a span covers by MIN_COVERED,
    distinct and sorted. score is the greatest share of a template or phrase that the text covers. A null or
    empty text has no word, no label (empty strings) and the score 0; rows alike are judged alike; an empty
    table gives no row; other columns are not read. Very long texts are read whole, in pieces.
    """
    rows, known = pick(docs, "doc_id", "text"), Templates(phrases, templates)
    id_type = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def scan(batches):
        for batch in batches:
            words, row, bounds = _read(known, batch)
            state, length = known.statistics(words, row)
            n = batch.num_rows
            count, low, high = np.zeros(n, np.int64), np.full(n, len(words), np.int64), np.full(n, -1, np.int64)
            base: list[set] = [set() for _ in range(n)]
            score = np.zeros(n)
            for p, last in known.places(state, length):
                of, first = row[last], last - known.lengths[p] + 1
                np.add.at(count, of, 1)
                np.minimum.at(low, of, first)
                np.maximum.at(high, of, first)
                score[of] = 1.0
                for r in np.unique(of).tolist():
                    base[r].add(known.labels[p])
            labels = [set(x) for x in base]
            for r, found in _template_spans(known, state, length, bounds):
                for t, _, _, covered in found:
                    share = covered / known.lengths[t]
                    score[r] = max(score[r], share)
                    if share >= MIN_COVERED:
                        labels[r].add(known.labels[t])
            none = count == 0
            places = [pa.array(np.where(none, 0, x - bounds[:-1]), pa.int64(), mask=none) for x in (low, high)]
            texts = [pa.array([",".join(sorted(x)) for x in found], pa.string()) for found in (base, labels)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(count), *places, *texts, pa.array(score)], schema=schema)

    return rows.mapInArrow(scan, f"doc_id {id_type.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
