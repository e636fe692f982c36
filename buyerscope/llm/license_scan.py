"""Licence scans with a generalised suffix automaton over the words of licence templates and phrases.

The automaton reads a text word by word and knows, at every word, the longest run of words ending there that occurs in any
template (matching statistics). Words that no template holds reset it, and so does a pair of neighbours that no template holds, so only
the runs between them are stepped, all runs of a batch at a time. Long matches of one template in ascending order are chained into
spans; a span that covers enough of a template labels the document. Phrases are found by the automaton too: a phrase ends wherever
its state lies on the suffix links of the current state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.byte_words import LOWER_WORD_CLASS, words_of
from buyerscope.llm.common import share, table

# The phrases that count as a base licence, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence notices and statements, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
)

MIN_MATCH = 4  # words of a long match; a shorter template must match whole
MAX_GAP = 12  # words of the text, and of the template, that a chain may leave out between two matches
MIN_SHARE = 0.8  # share of a template's words that a span must cover to give its label
MAX_WORDS = 5_000  # words of all templates: the automaton goes whole to every worker
_TOGETHER = 24  # runs stepped at a time; fewer are stepped one by one


def word_list(text: str) -> list[str]:
    """Words as the scan reads them: ASCII letters lower-cased, everything else that is ASCII separates."""
    return re.findall(LOWER_WORD_CLASS + "+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass
class _State:
    size: int
    link: int = -1
    to: dict[int, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Chain:
    """A span of a text that follows a template: words ``first`` to ``last``, ``covered`` words of the template matched."""

    template: int
    first: int
    last: int
    covered: int


class LicenseAutomaton:
    """Suffix automaton of several word sequences, with dense steps for words of its vocabulary."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]], min_match: int, max_gap: int):
        # Phrases are (phrase, label), templates (label, text).
        self.phrase_words = [word_list(p) for p, _ in phrases]
        self.template_words = [word_list(t) for _, t in templates]
        self.phrase_labels, self.template_labels = [label for _, label in phrases], [label for label, _ in templates]
        if not all(self.phrase_words + self.template_words):
            raise ValueError("every phrase and template needs a word")
        if sum(map(len, self.phrase_words + self.template_words)) > MAX_WORDS:
            raise ValueError(f"phrases and templates hold more than {MAX_WORDS} words")
        self.min_match, self.max_gap = min_match, max_gap
        names = sorted({w for words in self.phrase_words + self.template_words for w in words})
        self.vocabulary = [n.encode() for n in names]
        self.number = {n: i for i, n in enumerate(names)}
        self.states = [_State(0)]
        ends: list[tuple[int, int, int]] = []  # (state, sequence, position of the last word)
        sequences = self.template_words + self.phrase_words
        for which, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.number[word])
                ends.append((last, which, at))
        self._tabulate(ends, sequences)

    def _extend(self, last: int, word: int) -> int:
        """The state of the current sequence after one more word; states of earlier sequences are used again."""
        states = self.states
        if word in states[last].to:
            there = states[last].to[word]
            return there if states[there].size == states[last].size + 1 else self._split(last, word, there)
        new = len(states)
        states.append(_State(states[last].size + 1))
        at = last
        while at != -1 and word not in states[at].to:
            states[at].to[word] = new
            at = states[at].link
        if at == -1:
            states[new].link = 0
        else:
            there = states[at].to[word]
            states[new].link = there if states[there].size == states[at].size + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: int, there: int) -> int:
        states = self.states
        copy = len(states)
        states.append(_State(states[at].size + 1, states[there].link, dict(states[there].to)))
        states[there].link = copy
        while at != -1 and states[at].to.get(word) == there:
            states[at].to[word] = copy
            at = states[at].link
        return copy

    def _tabulate(self, ends: list[tuple[int, int, int]], sequences: list[list[str]]) -> None:
        states, n = self.states, len(self.states)
        by_size = sorted(range(n), key=lambda s: states[s].size)
        # Step table: the next state and the length it is cut to; -1 keeps the run and adds one word.
        self.next = np.zeros((n, len(self.number)), dtype=np.int32)
        self.size = np.zeros((n, len(self.number)), dtype=np.int32)
        for s in by_size:
            if s:
                self.next[s], self.size[s] = self.next[states[s].link], self.size[states[s].link]
                own = self.size[s] < 0
                self.size[s][own] = states[states[s].link].size + 1
            for word, there in states[s].to.items():
                self.next[s, word], self.size[s, word] = there, -1
        # Where the words of a state end in the templates, smallest states last, so that longer ones hand theirs down.
        places: list[set[tuple[int, int]]] = [set() for _ in states]
        phrase_state = {}
        for s, which, at in ends:
            if which < len(self.template_words):
                places[s].add((which, at))
            elif at == len(sequences[which]) - 1:
                phrase_state.setdefault(s, []).append(which - len(self.template_words))
        for s in reversed(by_size):
            if s:
                places[states[s].link] |= places[s]
        # Per state: phrases that end with it and the length they need; templates with the longest run that each of them knows.
        self.phrases: dict[int, list[tuple[int, int]]] = {}
        self.known: list[list[tuple[int, int, list[int]]]] = [[] for _ in states]
        for s in by_size[1:]:
            found = [(p, len(self.phrase_words[p])) for p in phrase_state.get(s, [])] + self.phrases.get(states[s].link, [])
            if found:
                self.phrases[s] = found
            own: dict[int, list[int]] = {}
            for template, at in sorted(places[s]):
                own.setdefault(template, []).append(at)
            self.known[s] = [(t, states[s].size, at) for t, at in own.items()]
            self.known[s] += [x for x in self.known[states[s].link] if x[0] not in own]
        self.has_phrase = np.zeros(n, dtype=bool)
        self.has_phrase[list(self.phrases)] = True
        self.pair = np.zeros((len(self.number), len(self.number)), dtype=bool)
        for words in sequences:
            ids = [self.number[w] for w in words]
            self.pair[ids[:-1], ids[1:]] = True
        self.short = min([self.min_match, *map(len, self.template_words)])

    def ids(self, words: pa.Array) -> np.ndarray:
        """Number of each word in the vocabulary, -1 for all others."""
        found = pa.compute.index_in(words, value_set=pa.array(self.vocabulary, pa.large_binary()))
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)

    def statistics(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and match length at every word; rows are texts of their own."""
        state, length = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids), dtype=np.int32)
        known = ids >= 0
        state[known], length[known] = self.next[0, ids[known]], 1
        tied = np.zeros(len(ids) + 1, dtype=bool)  # a word that goes on from the word before it
        tied[1:-1] = (rows[1:] == rows[:-1]) & known[1:] & known[:-1] & self.pair[ids[:-1], ids[1:]]
        starts = np.flatnonzero(tied[1:] & ~tied[:-1])
        stops = np.flatnonzero(tied[:-1] & ~tied[1:])  # last word of each run
        at, now, run = starts.copy(), state[starts], length[starts]
        while len(at) > _TOGETHER:
            at = at + 1
            word = ids[at]
            limit = self.size[now, word]
            run = np.where(limit < 0, run + 1, limit)
            now = self.next[now, word]
            state[at], length[at] = now, run
            on = at < stops
            at, now, run, stops = at[on], now[on], run[on], stops[on]
        for first, last, s, n in zip(at.tolist(), stops.tolist(), now.tolist(), run.tolist(), strict=True):
            for place, word in enumerate(ids[first + 1 : last + 1].tolist(), first + 1):
                limit = int(self.size[s, word])
                n, s = (n + 1 if limit < 0 else limit), int(self.next[s, word])
                state[place], length[place] = s, n
        return state, length

    def phrase_places(self, state: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of the first word, phrase) of every phrase."""
        for at in np.flatnonzero(self.has_phrase[state]).tolist():
            for phrase, need in self.phrases[int(state[at])]:
                if length[at] >= need:
                    yield at - need + 1, phrase

    def matches(self, state: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
        """(template, last word, words, last words in the template) of every match that its template does not carry on."""
        open_: dict[int, tuple[int, int, list[int]]] = {}
        before = -2
        for at in np.flatnonzero(length >= self.short).tolist():
            now = {}
            for template, size, places in self.known[int(state[at])]:
                size = min(size, int(length[at]))
                if size >= min(self.min_match, len(self.template_words[template])):
                    now[template] = (at, size, places)
            for template, old in open_.items():
                if before != at - 1 or template not in now or now[template][1] != old[1] + 1:
                    yield template, *old
            open_, before = now, at
        for template, old in open_.items():
            yield template, *old

    def chains(self, matches: Iterator[tuple[int, int, int, list[int]]]) -> list[Chain]:
        """Best chains of matches: in ascending order in text and template, with gaps of at most ``max_gap`` words in both.

        Each chain covers the most words of its template that any chain with the same last match covers; chains that overlap in the text are
        reduced to the one that covers most (then the first).
        """
        recent: dict[int, list[tuple[int, int, int, int]]] = {}  # template: (last word, last in template, covered, first word)
        done: dict[int, list[Chain]] = {}
        for template, end, size, places in matches:
            links, found = [x for x in recent.get(template, []) if end - size + 1 - x[0] - 1 <= self.max_gap], []
            for place in places:
                best = (size, end - size + 1)
                for last, spot, covered, first in links:
                    # Words that both matches claim count once.
                    fresh = min(size, place - spot, end - last)
                    if fresh > 0 and place - fresh - spot <= self.max_gap and covered + fresh > best[0]:
                        best = (covered + fresh, first)
                found.append((end, place, *best))
                done.setdefault(template, []).append(Chain(template, best[1], end, best[0]))
            recent[template] = links + found
        out = []
        for spans in done.values():
            taken: list[Chain] = []
            for group in _overlapping(spans):
                taken.append(min(group, key=lambda c: (-c.covered, c.first, c.last)))
            out += taken
        return out

    def share(self, chain: Chain) -> float:
        return min(chain.covered / len(self.template_words[chain.template]), 1.0)


def _overlapping(spans: list[Chain]) -> Iterator[list[Chain]]:
    """Spans of one template in groups that do not touch in the text."""
    group: list[Chain] = []
    reach = -1
    for span in sorted(spans, key=lambda c: (c.first, c.last)):
        if group and span.first > reach:
            yield group
            group = []
        group.append(span)
        reach = max(reach, span.last)
    if group:
        yield group


_HITS = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())]))
_SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
)


def scan(
    df: DataFrame, text: str = "text", *, carry: list[str] | None = None, phrases: tuple = PHRASES, templates: tuple = TEMPLATES,
    min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
) -> DataFrame:
    """Columns ``carry`` (all but the text by default) of every row with ``n_words``, ``phrase_hits`` and ``spans``.

    ``phrase_hits``: every place where a phrase's words stand one after another (first word from 0, phrase, label), by place.
    ``spans``: chained matches of each template (number, label, first and last word in the text, share of the template's words covered).

    The whole text is read. A null or empty text has no words. Rows are read one by one: ties and repeated rows get equal results, an empty
    table an empty one. Columns that carry the name of an added one raise an error unless ``carry`` leaves them out.
    """
    kept = [c for c in df.columns if c != text] if carry is None else list(carry)
    clash = {"n_words", "phrase_hits", "spans"} & set(kept)
    if clash:
        raise ValueError(f"columns cannot be carried under these names: {sorted(clash)}")
    built = share(df.sparkSession, "licences", LicenseAutomaton(list(phrases), list(templates), min_match, max_gap))
    names = [p for p, _ in phrases]
    n_kept = len(kept)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = built()
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros(n, dtype=np.int64)
            hits: list[list[dict]] = [[] for _ in range(n)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            for ids, rows in _whole_rows(batch.column(n_kept), automaton):
                state, length = automaton.statistics(ids, rows)
                counts += np.bincount(rows, minlength=n)
                first = np.searchsorted(rows, np.arange(n))  # a row's first word
                for at, phrase in automaton.phrase_places(state, length):
                    row = int(rows[at])
                    hits[row].append({"word": at - int(first[row]), "phrase": names[phrase], "label": automaton.phrase_labels[phrase]})
                long = np.flatnonzero(length >= automaton.short)
                for row in np.unique(rows[long]).tolist():
                    begin, end = int(first[row]), int(np.searchsorted(rows, row, side="right"))
                    for c in automaton.chains(automaton.matches(state[begin:end], length[begin:end])):
                        spans[row].append({
                            "label": automaton.template_labels[c.template], "template": c.template, "first_word": c.first, "last_word": c.last,
                            "share": automaton.share(c),
                        })
            for found in hits:
                found.sort(key=lambda h: (h["word"], h["phrase"]))
            for found in spans:
                found.sort(key=lambda h: (h["first_word"], h["last_word"], h["template"]))
            added = [pa.array(counts), pa.array(hits, _HITS), pa.array(spans, _SPANS)]
            schema = [*list(batch.schema)[:n_kept], pa.field("n_words", pa.int64()), pa.field("phrase_hits", _HITS), pa.field("spans", _SPANS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *added], schema=pa.schema(schema))

    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_scanned_text"))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_kept]]
    return rows.mapInArrow(
        read,
        ", ".join([
            *fields, "n_words long", "phrase_hits array<struct<word:long,phrase:string,label:string>>",
            "spans array<struct<label:string,template:int,first_word:long,last_word:long,share:double>>",
        ]),
    )


def _whole_rows(column: pa.Array, automaton: LicenseAutomaton) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and rows of a column; the pieces of one long text are put together (four bytes a word)."""
    ids, rows = [], []
    for words in words_of(column):
        if ids and not words.continues:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows = [], []
        ids.append(automaton.ids(words.array()))
        rows.append(words.rows.astype(np.int32))
    if ids:
        yield np.concatenate(ids), np.concatenate(rows)


def op12_license_automaton(spark, folder: str) -> DataFrame:
    """Words, phrase places, labels and score of every document.

    ``labels`` adds to the base labels those of all templates of which a span covers at least ``MIN_SHARE``; ``score`` is the largest
    covered share of any template, 1 if a phrase stands in the text. Null texts count as empty.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan(docs)
    base = F.array_distinct(F.col("phrase_hits")["label"])
    covered = F.filter("spans", lambda s: s["share"] >= MIN_SHARE)["label"]
    shares = F.coalesce(F.array_max(F.col("spans")["share"]), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("phrase_hits").cast("long").alias("n_base"),
        F.array_min(F.col("phrase_hits")["word"]).alias("first_word"), F.array_max(F.col("phrase_hits")["word"]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, covered)), ",").alias("labels"),
        F.when(F.size("phrase_hits") > 0, F.lit(1.0)).otherwise(shares).alias("score"),
    )
