"""License scans by matching of template markup.

A template is the wording of a license or notice with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be
left out (regions may be nested), ``<<var lo hi>>`` stands for lo to hi words of any wording. A template is compiled to an
automaton over words; its states are places in the wording, and an optional region is an edge without a word. A text is
accepted where all mandatory words stand in their order with nothing between but what the markup allows.

Templates begin with mandatory words, so a match can only begin where these stand. Such places are found for a whole
batch at once on word codes; from each the automaton runs, made deterministic step by step, until it accepts or has no
state left. It takes the shortest match, and never more words than the template with its regions has.

Words are runs of ASCII letters and digits and of all other code points, with A-Z lower-cased.

Defined cases: a null or empty text has no words, no place and the score 0; equal rows get equal results, each row its
own; texts are read whole whatever their length; an empty table gives an empty result; input columns called like a result
column give way to it. Of matches that begin at one word, each template gives one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lessonlens.llm.batches import with_columns_of
from lessonlens.llm.words import flat

BLOCK = 1 << 20
DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
MATCHES = "array<struct<label:string,start:bigint,words:bigint>>"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
WORDLY = np.zeros(256, bool)
WORDLY[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r"<<(beginOptional|endOptional|var \d+ \d+)>>")

# Phrases and labels of the base rule
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and notices. Optional regions hold what editions differ in, var regions names and dates
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var 1 12>> (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.""",
        """Released under the <<beginOptional>>terms of the<<endOptional>> MIT License""",
        """Licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"""),
    "apache-2.0": (
        """Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License, Version 2.0""",),
    "gpl-2.0": (
        """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 2""",
        """under the terms of the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 2""",),
    "gpl-3.0": (
        """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 3""",
        """under the terms of the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 3""",),
    "lgpl": (
        """under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Library<<endOptional>> General Public License
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>>
        version 2.1""",
        """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License""",),
    "bsd": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the <<beginOptional>>above
        <<endOptional>> copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
        """Licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>><<var 1 2>><<endOptional>> BSD License""",),
    "isc": (
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the <<var 1 8>> be held liable for
        any damages arising from the use of this software.""",),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
        """Licensed under the <<beginOptional>>terms of the<<endOptional>> Mozilla Public License, <<beginOptional>>version<<endOptional>>
        <<beginOptional>>v<<endOptional>> 2.0""",),
    "unlicense": (
        """This is free and unencumbered software released into the public domain.""",),
    "cc-by-nc": (
        """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC
        <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> 4.0""",
        """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution-NonCommercial
        <<beginOptional>>ShareAlike<<endOptional>> <<beginOptional>>NoDerivatives<<endOptional>> 4.0""",),
    "cc-by": (
        """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY <<beginOptional>>SA<<endOptional>>
        <<beginOptional>>ND<<endOptional>> 4.0""",
        """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution
        <<beginOptional>>ShareAlike<<endOptional>> <<beginOptional>>NoDerivatives<<endOptional>> 4.0""",),
}


@dataclass(frozen=True)
class Region:
    """Part of a template: a word, an optional region (``parts``), or lo to hi words of any wording."""

    word: str = ""
    parts: tuple["Region", ...] | None = None
    lo: int = 0
    hi: int = 0


def words_of(text: str) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def regions(markup: str) -> tuple[Region, ...]:
    """The regions of a template; an error for markup that does not close, or that does not begin with a mandatory word."""
    open_: list[list[Region]] = [[]]
    pieces = MARK.split(markup)
    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            open_[-1].extend(Region(w) for w in words_of(piece))
        elif piece == "beginOptional":
            open_.append([])
        elif piece == "endOptional":
            if len(open_) == 1:
                raise ValueError(f"an optional region ends that did not begin: {markup[:60]}")
            inner = tuple(open_.pop())
            open_[-1].append(Region(parts=inner))
        else:
            lo, hi = map(int, piece.split()[1:])
            if lo > hi:
                raise ValueError(f"a region of {lo} to {hi} words")
            if hi:
                open_[-1].append(Region(lo=lo, hi=hi))
    if len(open_) > 1:
        raise ValueError(f"an optional region does not end: {markup[:60]}")
    if not open_[0] or not open_[0][0].word or not open_[0][-1].word:
        raise ValueError(f"a template begins and ends with mandatory words: {markup[:60]}")
    return tuple(open_[0])


class Automaton:
    """States are numbers of places; ``by_word[s]`` and ``any_word`` lead on with a word, ``free[s]`` without one."""

    def __init__(self, label: str, markup: str, codes: dict[str, int]):
        self.label = label
        parts = regions(markup)
        self.head = [codes[p.word] for p in parts[:next((i for i, p in enumerate(parts) if not p.word), len(parts))]]
        self.by_word: list[int | None] = []
        self.any_word: list[bool] = []
        self.free: list[list[int]] = []
        self.end = self._add(parts, self._state(), codes)
        self.steps: dict[tuple[frozenset[int], int], frozenset[int]] = {}
        self.begin = self._closed({0})

    def _state(self) -> int:
        self.by_word.append(None)
        self.any_word.append(False)
        self.free.append([])
        return len(self.free) - 1

    def _add(self, parts: tuple[Region, ...], at: int, codes: dict[str, int]) -> int:
        """Adds regions behind state ``at``, state by state in order, so that a word leads from s to s + 1."""
        for part in parts:
            if part.word:
                self.by_word[at] = codes[part.word]
                at = self._state()
            elif part.parts is not None:
                entry = at
                inner = self._add(part.parts, self._after(entry), codes)
                at = self._after(inner)
                self.free[entry].append(at)
            else:
                entries = []
                for k in range(part.hi):
                    if k >= part.lo:
                        entries.append(at)
                    self.any_word[at] = True
                    at = self._state()
                at = self._after(at)
                for entry in entries:
                    self.free[entry].append(at)
        return at

    def _after(self, state: int) -> int:
        after = self._state()
        self.free[state].append(after)
        return after

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], code: int) -> frozenset[int]:
        found = self.steps.get((states, code))
        if found is None:
            found = self._closed({s + 1 for s in states if self.any_word[s] or self.by_word[s] == code})
            if len(self.steps) < 200_000:
                self.steps[states, code] = found
        return found

    def match(self, codes: list[int], start: int, stop: int) -> int:
        """Words of the shortest match from ``start``, 0 if there is none before ``stop``."""
        states = self.begin
        for at in range(start, stop):
            states = self.step(states, codes[at])
            if not states:
                return 0
            if self.end in states:
                return at + 1 - start
        return 0


class Scanner:
    """Base phrases and compiled templates over one list of known words; other words have the code -1."""

    made: dict[int, "Scanner"] = {}

    def __init__(self, templates: dict[str, tuple[str, ...]], base: dict[str, str]):
        def known(parts: tuple[Region, ...]) -> Iterator[str]:
            for p in parts:
                yield from [p.word] if p.word else known(p.parts or ())

        vocabulary = sorted({w for group in templates.values() for t in group for w in known(regions(t))} | {w for p in base for w in words_of(p)})
        codes = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array([w.encode() for w in vocabulary], pa.binary())
        self.templates = [Automaton(label, t, codes) for label, group in templates.items() for t in group]
        self.base = [([codes[w] for w in words_of(phrase)], label) for phrase, label in base.items()]

    @classmethod
    def of(cls, templates: dict[str, tuple[str, ...]], base: dict[str, str]) -> "Scanner":
        key = hash((tuple(templates.items()), tuple(base.items())))
        if key not in cls.made:
            cls.made[key] = cls(templates, base)
        return cls.made[key]


def coded(column: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For texts in runs of at most BLOCK bytes (or one longer text): the first text, the words' codes, the texts' borders."""
    data, bounds = flat(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1))
        own = bounds[i:j + 1] - bounds[i]
        part = LOWER[data[int(bounds[i]):int(bounds[j])]]
        inside = WORDLY[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = True
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1] | edge[1:-1]
        starts = np.flatnonzero(fresh)
        offsets = np.zeros(len(starts) + 1, np.int64)
        packed = part[inside]
        offsets[:-1] = (np.cumsum(inside) - 1)[starts] if len(starts) else 0
        offsets[-1] = len(packed)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        codes = pc.index_in(words, vocabulary.cast(pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False)
        yield i, codes.astype(np.int64), np.searchsorted(starts, own)
        i = j


def standing(codes: np.ndarray, phrase: list[int], last: np.ndarray) -> np.ndarray:
    """Places where the words of a phrase stand consecutively inside one text; ``last[i]`` ends the text of word i."""
    m = len(codes) - len(phrase) + 1
    if m <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(codes[:m] == phrase[0])
    for k, code in enumerate(phrase[1:], 1):
        at = at[codes[at + k] == code]
    return at[at + len(phrase) <= last[at]]


def scanned(column: pa.Array, scanner: Scanner) -> Iterator[tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For every text: number of words, base places and template matches, each as (label, first word, words)."""
    for _, codes, cuts in coded(column, scanner.vocabulary):
        last = np.repeat(cuts[1:], np.diff(cuts))
        base, matches = [], []
        for phrase, label in scanner.base:
            base += [(int(a), label, len(phrase)) for a in standing(codes, phrase, last)]
        listed = None
        for template in scanner.templates:
            for a in standing(codes, template.head, last).tolist():
                listed = codes.tolist() if listed is None else listed
                if size := template.match(listed, a, int(last[a])):
                    matches.append((a, template.label, size))
        base.sort()
        matches.sort()
        b = m = 0
        for k in range(len(cuts) - 1):
            lo, hi = int(cuts[k]), int(cuts[k + 1])
            b0, m0 = b, m
            while b < len(base) and base[b][0] < hi:
                b += 1
            while m < len(matches) and matches[m][0] < hi:
                m += 1
            yield (hi - lo, [(label, a - lo, size) for a, label, size in base[b0:b]],
                   [(label, a - lo, size) for a, label, size in matches[m0:m]])


def _mapped(docs: DataFrame, text: str, ddl: str, keep: list[str], templates, base, make) -> DataFrame:
    Scanner(templates, base)  # an error in a template is raised here

    def columns(batch: pa.RecordBatch) -> list[tuple]:
        scanner = Scanner.of(templates, base)
        return list(zip(*[make(*found) for found in scanned(batch.column(batch.num_columns - 1), scanner)]))

    return with_columns_of(docs, text, ddl, columns, keep)


def license_matches(docs: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES,
                    keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``matches``: every accepted template with its first word and length, in order."""
    def make(n: int, base: list, matches: list) -> tuple:
        return ([{"label": label, "start": a, "words": size} for label, a, size in matches],)

    return _mapped(docs, text, f"matches {MATCHES}", docs.columns if keep is None else keep, templates, {}, make)


def license_report(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The columns of the query. The score is 1 where a template is accepted, 0.5 where only base phrases stand, else 0."""
    def make(n: int, base: list, matches: list) -> tuple:
        own = {label for label, _, _ in base}
        places = [a for _, a, _ in base]
        return (n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)),
                ",".join(sorted(own | {label for label, _, _ in matches})), 1.0 if matches else 0.5 if base else 0.0)

    return _mapped(docs.select("doc_id", "text"), "text", DDL, ["doc_id"], templates, BASE, make)


def template_pattern(markup: str) -> str:
    """The template as a regular expression over words that each end with a blank; for checks."""
    def of(parts: tuple[Region, ...]) -> str:
        return "".join(p.word + " " if p.word else f"(?:{of(p.parts)})?" if p.parts is not None else f"(?:[^ ]+ ){{{p.lo},{p.hi}}}" for p in parts)

    return of(regions(markup))
