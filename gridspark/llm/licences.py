"""Licence scans: a generalised suffix automaton of licence templates, streamed over the words of whole texts.

The automaton gives, at every word, the longest run of words up to there that occurs in some template (matching
statistics), and its suffix links give the shorter runs of other templates. Runs that cannot be extended are chained, per
template, along the text and the template, each after its best predecessor; a chain that covers enough words of the
template is reported as a span of the text and of the template. A run never crosses a word that no template has, so only
stretches of template words are streamed. Fixed phrases are found beside it and always reported.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.text import ALPHANUMERIC, Piece, pieces

# The phrases and labels of the task.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short passages of public licence texts and notices.
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
# Longer passages of the same public licences; the label is what stands before the stroke.
TEMPLATES |= {
    "mit/permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.",
    "mit/warranty": "The software is provided as is, without warranty of any kind, express or implied, including but not "
    "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event "
    "shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
    "of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other "
    "dealings in the software.",
    "bsd/conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache/notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
    "License for the specific language governing permissions and limitations under the License.",
    "gpl/warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
    "for more details.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for "
    "any purpose, commercial or non-commercial, and by any means.",
}
#: Words of a run that counts, at least; a shorter template must occur whole.
SHORTEST = 5
#: Words between two runs of a chain, at most.
GAP = 30
#: Share of a template's words that a chain must cover.
COVERED = 0.6


def _words(text: str) -> list[bytes]:
    piece = next(pieces(pa.array([text])))
    return [piece.lower[a:b].tobytes() for a, b in zip(*piece.spans(ALPHANUMERIC)[:2], strict=True)]


@dataclass
class Automaton:
    """States of the suffix automaton: transitions by word id, suffix link, longest length, and all places, as template
    and number of words up to there, where it ends. Templates are named by label, a stroke and anything."""

    labels: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    vocabulary: list[bytes] = field(default_factory=list)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    @classmethod
    def of(cls, templates: dict[str, str]) -> Automaton:
        own = cls(labels=[name.split("/")[0] for name in templates])
        ids: dict[bytes, int] = {}
        for t, text in enumerate(templates.values()):
            tokens = [ids.setdefault(w, len(ids)) for w in _words(text)]
            own.sizes.append(len(tokens))
            last = 0
            for at, token in enumerate(tokens):
                last = own._extend(last, token)
                own.ends[last].add((t, at + 1))
        own.vocabulary = list(ids)
        for state in sorted(range(1, len(own.link)), key=lambda s: -own.longest[s]):  # where a run ends, its suffixes end
            if own.link[state] > 0:
                own.ends[own.link[state]] |= own.ends[state]
        return own

    def _new(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, parent: int, token: int) -> int:
        """State of exactly ``longest[parent] + 1`` words reached from ``parent``, made by cloning if need be."""
        target = self.step[parent][token]
        if self.longest[target] == self.longest[parent] + 1:
            return target
        clone = self._new(self.longest[parent] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = clone
        while parent >= 0 and self.step[parent].get(token) == target:
            self.step[parent][token] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.step[last]:
            return self._split(last, token)
        added = self._new(self.longest[last] + 1, {}, 0)
        while last >= 0 and token not in self.step[last]:
            self.step[last][token] = added
            last = self.link[last]
        if last >= 0:
            self.link[added] = self._split(last, token)
        return added

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run that ends at each word."""
        state = length = 0
        for token in tokens:
            nxt = self.step[state].get(token)
            while state > 0 and nxt is None:
                state = self.link[state]
                length = self.longest[state]
                nxt = self.step[state].get(token)
            state, length = (0, 0) if nxt is None else (nxt, length + 1)
            yield state, length

    def places(self, state: int, length: int, least: int) -> dict[tuple[int, int], int]:
        """Where in the templates runs of at least ``least`` words end that end here, each with its length."""
        out: dict[tuple[int, int], int] = {}
        while state > 0 and length >= least:
            for place in self.ends[state]:
                out.setdefault(place, length)
            state = self.link[state]
            length = self.longest[state]
        return out

    def runs(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """The runs of at least ``least`` words that no word extends, in the order of their ends: end, a start that
        no later run comes before, and (template, end in the template, length) of each."""
        open_: dict[tuple[int, int], int] = {}
        floor = 0
        for at, (state, length) in enumerate(self.statistics(tokens)):
            here = self.places(state, length, least)
            ended = [(t, end, n) for (t, end), n in open_.items() if (t, end + 1) not in here]
            if ended:
                yield at, floor, sorted(ended)
            open_, floor = here, at + 1 - length
        if open_:
            yield len(tokens), floor, sorted((t, end, n) for (t, end), n in open_.items())


@dataclass(frozen=True)
class Span:
    """A chain: words ``start`` to ``end`` of the text cover ``covered`` words of a template from ``template_start`` to
    ``template_end`` (ends exclusive)."""

    template: int
    start: int
    end: int
    template_start: int
    template_end: int
    covered: int


class _Chains:
    """The chains of one template: every run follows the predecessor, at most ``GAP`` words before it, that covers most."""

    def __init__(self, template: int, size: int):
        self.template, self.size = template, size
        self.near: deque[Span] = deque()
        self.best = 0
        #: the best chain of each first run, if it covers enough
        self.whole: dict[tuple[int, int], Span] = {}

    def add(self, start: int, end: int, t_end: int, floor: int) -> None:
        length = end - start
        while self.near and self.near[0].end < floor - GAP:
            self.near.popleft()
        chain = Span(self.template, start, end, t_end - length, t_end, length)
        for before in self.near:
            if before.end < end and before.template_end < t_end and start - before.end <= GAP:
                covered = before.covered + min(end - max(start, before.end), t_end - max(t_end - length, before.template_end))
                if covered > chain.covered:
                    chain = Span(self.template, before.start, end, before.template_start, t_end, covered)
        self.near.append(chain)
        self.best = max(self.best, chain.covered)
        first = (chain.start, chain.template_start)
        if chain.covered >= COVERED * self.size and (first not in self.whole or chain.covered > self.whole[first].covered):
            self.whole[first] = chain

    def spans(self) -> list[Span]:
        """Chains that cover enough, none overlapping another in the text, the most covering first."""
        starts: list[int] = []
        taken: list[Span] = []
        for span in sorted(self.whole.values(), key=lambda s: (-s.covered, s.start, s.end, s.template_start)):
            at = bisect_left(starts, span.start)
            free = (at == 0 or taken[at - 1].end <= span.start) and (at == len(starts) or span.end <= starts[at])
            if free:
                starts.insert(at, span.start)
                taken.insert(at, span)
        return taken


class Scanner:
    """The automaton and phrases, with word hashes in place of words."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automaton = Automaton.of(templates)
        self.least = min([SHORTEST, *self.automaton.sizes])
        phrase_words = {p: _words(p) for p in phrases}
        words = list(dict.fromkeys([*self.automaton.vocabulary, *(w for ws in phrase_words.values() for w in ws)]))
        piece = next(pieces(pa.array([b" ".join(words).decode()])))
        starts, ends, _ = piece.spans(ALPHANUMERIC)
        hashes = piece.hashes(starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.phrases = [([words.index(w) for w in ws], phrases[p]) for p, ws in phrase_words.items()]

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words that neither template nor phrase has."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.order[at], -1)

    def phrase_places(self, ids: np.ndarray) -> list[tuple[np.ndarray, str, int]]:
        out = []
        for tokens, label in self.phrases:
            count = max(0, len(ids) - len(tokens) + 1)
            at = np.flatnonzero(ids[:count] == tokens[0])
            for j, token in enumerate(tokens[1:], 1):
                at = at[ids[at + j] == token]
            out.append((at, label, len(tokens)))
        return out

    def chained(self, ids: np.ndarray) -> tuple[float, list[Span]]:
        """The largest share of a template that a chain of runs covers, and the spans of those that cover enough."""
        known = (ids >= 0) & (ids < len(self.automaton.vocabulary))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
        sizes = self.automaton.sizes
        chains: dict[int, _Chains] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            for end, floor, runs in self.automaton.runs(ids[a:b].tolist(), self.least):
                for t, t_end, length in runs:
                    if length >= min(SHORTEST, sizes[t]):
                        chains.setdefault(t, _Chains(t, sizes[t])).add(a + end - length, a + end, t_end, a + floor)
        share = max((c.best / c.size for c in chains.values()), default=0.0)
        return share, sorted((s for c in chains.values() for s in c.spans()), key=lambda s: (s.start, s.end, s.template))


def _found(piece: Piece, scanner: Scanner) -> Iterator[dict]:
    starts, ends, first = piece.spans(ALPHANUMERIC)
    ids = scanner.ids(piece.hashes(starts, ends))
    places = scanner.phrase_places(ids)
    for i in range(piece.n):
        a, b = int(first[i]), int(first[i + 1])
        base, label_set, low, high = 0, set(), None, None
        for at, label, size in places:
            own = at[np.searchsorted(at, a) : np.searchsorted(at, b - size, side="right")]
            if len(own):
                base += len(own)
                label_set.add(label)
                low = min(int(own[0]) - a, low if low is not None else b)
                high = max(int(own[-1]) - a, high if high is not None else -1)
        share, spans = scanner.chained(ids[a:b])
        label_of = scanner.automaton.labels
        more = {label_of[span.template] for span in spans}
        yield {
            "n_words": b - a, "n_base": base, "first_word": low, "last_word": high,
            "base_labels": ",".join(sorted(label_set)), "labels": ",".join(sorted(label_set | more)),
            "score": 1.0 if base else min(1.0, share),
            "spans": [
                {"label": label_of[x.template], "start": x.start, "end": x.end, "template": x.template,
                 "template_start": x.template_start, "template_end": x.template_end, "covered": x.covered} for x in spans
            ],
        }


_PLACES = ("start", "end", "template", "template_start", "template_end", "covered")
_FIELDS = (
    ("n_words", pa.int64(), "bigint"), ("n_base", pa.int64(), "bigint"), ("first_word", pa.int64(), "bigint"),
    ("last_word", pa.int64(), "bigint"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"),
    ("score", pa.float64(), "double"),
    ("spans", pa.list_(pa.struct([("label", pa.string()), *((n, pa.int64()) for n in _PLACES)])),
     "array<struct<label:string," + ",".join(f"{n}:bigint" for n in _PLACES) + ">>"),
)


def scan(text: Column | str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """Struct of ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``spans``.

    Null and empty texts have no words, no labels (empty strings), no spans and score 0. ``score`` is 1 if a phrase occurs,
    else the largest covered share of a template. ``spans`` are the covered spans by start: label, words of the text
    (``start``, ``end``), number and words of the template, and how many of them are covered.
    """
    scanner = Scanner(templates or TEMPLATES, phrases or PHRASES)

    @F.arrow_udf("struct<" + ",".join(f"{name}:{kind}" for name, _, kind in _FIELDS) + ">")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [row for piece in pieces(texts) for row in _found(piece, scanner)]
            yield pa.array(rows, pa.struct([(name, kind) for name, kind, _ in _FIELDS]))

    return scanned(text)


def licences(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the fields of ``scan`` for every row.

    Rows are scanned one by one: repeated rows and null ids stay, other columns don't matter, no rows give none.
    """
    return documents.select("doc_id", scan().alias("found")).select("doc_id", "found.*")
