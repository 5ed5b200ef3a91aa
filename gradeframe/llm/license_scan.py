"""Licence texts found with a generalised suffix automaton.

The automaton of all licence templates is a few kilobytes and travels with the tasks. Each text is
streamed through it once: after every word the automaton knows the longest run of words ending there
that occurs in any template (the matching statistics). Base phrases are read off the states; long
matches are chained per template by dynamic programming, and a chain that covers enough of its template is a
labelled span.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that are reported wherever their words stand, with their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices of common licences in normalised words, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
    ),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "apache",
        "licensed to the apache software foundation asf under one or more contributor license agreements see the notice "
        "file distributed with this work for additional information regarding copyright ownership",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license "
        "2 0 which is available at",
    ),
    (
        "bsl",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license the software to use reproduce display distribute execute "
        "and transmit the software",
    ),
    ("bsl", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "this work has been dedicated to the public domain"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software",
    ),
    (
        "agpl",
        "under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
)

# Identifiers of licence tags in normalised words, with their labels.
TAGS = {
    "mit": "mit",
    "apache 2 0": "apache",
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl",
    "agpl 3 0": "agpl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mpl 2 0": "mpl",
    "epl 2 0": "epl",
    "bsl 1 0": "bsl",
    "isc": "isc",
    "zlib": "zlib",
    "unlicense": "unlicense",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
}
TAG = "spdx license identifier"

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,template:int,start:long,stop:long,covered:int>>"
)

_SPLIT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


class SuffixAutomaton:
    """All runs of words of several texts; a state stands for runs with the same ends."""

    def __init__(self, texts: list[list[bytes]]):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.vocabulary: dict[bytes, int] = {}
        ends: list[set] = [set()]
        for number, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._append(last, self.vocabulary.setdefault(word, len(self.vocabulary)), ends)
                ends[last].add((number, at + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        ends[0] = set()
        self.ends = [tuple(sorted(e)) for e in ends]

    def _state(self, length: int, ends: list[set]) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, at: int, token: int, ends: list[set]) -> int:
        """The state of the run that ``at`` reads with ``token``, cut out of a longer one if needed."""
        target = self.step[at][token]
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, ends)
        self.step[copy] = dict(self.step[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at >= 0 and self.step[at].get(token) == target:
            self.step[at][token] = copy
            at = self.link[at]
        return copy

    def _append(self, last: int, token: int, ends: list[set]) -> int:
        if token in self.step[last]:
            return self._split(last, token, ends)
        state = self._state(self.length[last] + 1, ends)
        at = last
        while at >= 0 and token not in self.step[at]:
            self.step[at][token] = state
            at = self.link[at]
        self.link[state] = self._split(at, token, ends) if at >= 0 else 0
        return state

    def find(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.step[state][self.vocabulary[word]]
        return state


class Scanner:
    """Reads one text after the other; built once per task from the small templates."""

    def __init__(self, templates, phrases, min_match: int, max_gap: int, min_cover: float, tags=TAGS):
        tagged = [(label, f"{TAG} {name}") for name, label in tags.items()]
        self.labels = [label for label, _ in [*templates, *tagged]] + list(phrases.values())
        texts = [words_of(text) for _, text in [*templates, *tagged]] + [words_of(phrase) for phrase in phrases]
        self.sizes = [len(t) for t in texts]
        self.n_templates = len(templates) + len(tagged)
        # words a chain must cover: of a tag all, as its last ones tell the licence
        self.need = [n * (min_cover if i < len(templates) else 1) for i, n in enumerate(self.sizes)]
        self.min_match, self.max_gap = min_match, max_gap
        self.automaton = a = SuffixAutomaton(texts)
        own: dict[int, list] = {}
        for phrase, label in phrases.items():
            own.setdefault(a.find(words_of(phrase)), []).append((len(words_of(phrase)), label))
        # base phrases that end wherever a state is reached, with the match length they need
        self.endings = [()] * len(a.link)
        for state in sorted(range(len(a.link)), key=lambda s: a.length[s]):
            above = self.endings[a.link[state]] if state else ()
            self.endings[state] = tuple(own.get(state, ())) + above

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        a, endings = self.automaton, self.endings
        step, link, length = a.step, a.link, a.length
        known = a.vocabulary.get
        base, matches = [], []
        state = run = 0
        before = -2
        for at, token in enumerate(map(known, words)):
            if token is None:
                continue
            if at != before + 1:
                if run >= self.min_match:
                    matches.append((before + 1 - run, run, state))
                state = run = 0
            elif token not in step[state]:
                if run >= self.min_match:
                    matches.append((at - run, run, state))
                while state and token not in step[state]:
                    state = link[state]
                    run = length[state]
            before = at
            after = step[state].get(token)
            if after is None:
                state = run = 0
                continue
            state, run = after, run + 1
            if endings[state]:
                base += [(at + 1 - size, label) for size, label in endings[state] if size <= run]
        if run >= self.min_match:
            matches.append((before + 1 - run, run, state))
        spans = self.chains(matches)
        labels = {label for _, label in base}
        score = 1.0 if base else max((s[4] / self.sizes[s[1]] for s in spans), default=0.0)
        spans = [s for s in spans if s[4] >= self.need[s[1]]]
        return (
            len(words),
            len(base),
            min((start for start, _ in base), default=None),
            max((start for start, _ in base), default=None),
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {s[0] for s in spans})),
            float(score),
            spans,
        )

    def chains(self, matches) -> list[tuple]:
        """The chains of matches per template that cover most, as spans that do not overlap.

        Matches of a chain follow each other in the text and in the template, with gaps of at most ``max_gap`` words;
        what two of them share counts once. Of each template the best chain is given, and others beside it that
        cover enough.
        """
        places: dict[int, list[tuple[int, int, int]]] = {}
        for start, size, state in matches:
            for number, end in self.automaton.ends[state]:
                if number < self.n_templates:
                    places.setdefault(number, []).append((start, end - size, size))
        return sorted(span for number, found in places.items() for span in self._best(number, sorted(found)))

    def _best(self, number: int, found: list[tuple[int, int, int]]) -> list[tuple]:
        best: list[tuple[int, int]] = []  # words covered by the best chain up to a match, and where that begins
        near: list[int] = []  # matches that end late enough to be followed
        for i, (start, begin, size) in enumerate(found):
            near = [j for j in near if found[j][0] + found[j][2] + self.max_gap >= start]
            covered, first = size, start
            for j in near:
                stop, at = found[j][0] + found[j][2], found[j][1] + found[j][2]
                skip = max(0, stop - start, at - begin)  # what the chain has already
                gaps = start + skip - stop, begin + skip - at
                if skip < size and max(gaps) <= self.max_gap and best[j][0] + size - skip > covered:
                    covered, first = best[j][0] + size - skip, best[j][1]
            best.append((covered, first))
            near.append(i)
        spans: list[tuple] = []
        for (covered, first), (start, _, size) in sorted(zip(best, found), key=lambda x: (-x[0][0], x[0][1], x[1])):
            if spans and covered < self.need[number]:
                break
            if all(start + size <= s[2] or first >= s[3] for s in spans):
                spans.append((self.labels[number], number, first, start + size, covered))
        return spans


def license_scan(
    docs: DataFrame,
    text: str | Column = "text",
    templates=TEMPLATES,
    phrases=None,
    min_match: int = 2,
    max_gap: int = 3,
    min_cover: float = 0.75,
    keep: tuple[str, ...] = ("doc_id",),
    tags=TAGS,
) -> DataFrame:
    """The licences named in each text: one row per input row, with the columns of ``keep``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` speak of the phrases alone; ``labels``
    also has the labels of templates of which a chain of matches covers ``min_cover`` of the words, and of licence
    tags (``SPDX-License-Identifier: ...``) that stand whole.
    ``score`` is 1 where a phrase stands, else the largest covered share of any template.

    Null and empty texts give no words, no labels and score 0; repeated rows are scanned each on their
    own; an empty table gives an empty table; other columns are not read. A row is streamed word by word,
    so its cost follows its length. Nothing is shuffled.
    """
    scanner = Scanner(templates, BASE_PHRASES if phrases is None else phrases, min_match, max_gap, min_cover, tags)

    @F.pandas_udf(SCHEMA)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in texts:
            found = pd.DataFrame([scanner.scan(t) for t in batch], columns=names)
            for name in ("first_word", "last_word"):
                found[name] = found[name].astype("Int64")
            yield found

    column = F.col(text) if isinstance(text, str) else text
    found = docs.select(*keep, scan(column).alias("_scan"))
    return found.select(*keep, "_scan.*")
