import random
import re

import pytest
from helpers import DOCS, by_id, docs_of

import __spark_entry__ as entry
from gradeframe.llm import license_scan as L


def restated(text):
    """Base columns by looking at every place of the words."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [
        (i, label)
        for phrase, label in L.BASE_PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(places, default=None), max(places, default=None), labels


EDGES = [
    None,
    "",
    "   \n ",
    "CC BY cc-by cc by cc by, all rights reserved",
    "All Rights Reserved. all rights all rights reserved",
    "GNU general public general public license general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated",
    "É ß cc BY ünï 9cc by cc by9",
    "This program is free software: you can redistribute it and/or modify it under the terms of our own rules.",
    "cc " * 5000 + "by",
]


def test_base_columns_equal_brute_force(spark, data):
    docs = docs_of(spark, EDGES).union(spark.read.parquet(f"{data}/documents.parquet"))
    texts = [r.text for r in docs.select("text").collect()]
    found = L.license_scan(docs).collect()
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found]
    assert got == [restated(t) for t in texts]
    assert all(0 <= r.score <= 1 for r in found)


def test_template_labels(spark):
    found = by_id(
        L.license_scan(
            docs_of(
                spark,
                [
                    "Released under the MIT License.",
                    "released under some license",
                    "Licensed under the Apache License, Version 2.0.",
                    "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software "
                    "and associated documentation files (the Software), to deal in the Software without restriction",
                    "free of charge to any person",
                ],
            )
        )
    )
    assert [found[i].labels for i in range(5)] == ["mit", "", "apache", "mit", ""]
    assert found[0].spans[0].start == 0 and found[0].spans[0].stop == 5
    assert found[3].spans[0].covered >= 20
    assert 0 < found[4].score < 0.5


def test_automaton_knows_all_runs_and_no_others():
    texts = [b"a b a b c".split(), b"b a b a".split(), b"c c c".split()]
    a = L.SuffixAutomaton(texts)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}

    def holds(run):
        state = 0
        for word in run:
            state = a.step[state].get(a.vocabulary[word], -1)
            if state < 0:
                return False
        return True

    from itertools import product

    for n in range(1, 5):
        for run in product([b"a", b"b", b"c"], repeat=n):
            assert holds(run) == (run in runs)
            if holds(run):
                ends = {(k, j) for k, t in enumerate(texts) for j in range(n, len(t) + 1) if tuple(t[j - n : j]) == run}
                assert set(a.ends[a.find(list(run))]) == ends


def test_empty_table_repeats_and_other_columns(spark):
    assert L.license_scan(spark.createDataFrame([], DOCS)).count() == 0
    docs = docs_of(spark, ["cc by", "cc by"], extra=["1 as n_words", "'x' as labels", "2 as score"])
    assert [r.n_base for r in L.license_scan(docs.union(docs)).collect()] == [1] * 4


def test_query_covers_the_whole_table(spark, data):
    found = entry.queries()["op1_license_scan"](spark, data)
    assert found.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert found.columns[:8] == [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    ]


@pytest.mark.parametrize("gap, label", [(2, "bsd"), (30, "")])
def test_chains_allow_small_gaps_only(spark, gap, label):
    text = next(t for label, t in L.TEMPLATES if label == "bsd").split()
    cut = text[:11] + ["x"] * gap + text[11:]
    assert by_id(L.license_scan(docs_of(spark, [" ".join(cut)])))[0].labels == label


def covered_by_search(words, template, min_match, max_gap):
    """Most words that any chain of maximal common runs covers, by trying all chains."""
    n = len(template)
    runs = []
    for i in range(len(words)):
        for j in range(n):
            if words[i] == template[j] and (i == 0 or j == 0 or words[i - 1] != template[j - 1]):
                size = 0
                while i + size < len(words) and j + size < n and words[i + size] == template[j + size]:
                    size += 1
                if size >= min_match:
                    runs.append((i, j, size))
    runs.sort()

    def grow(at, stop, end, covered):
        best = covered
        for k in range(at, len(runs)):
            i, j, size = runs[k]
            skip = max(0, stop - i, end - j)
            if skip < size and i + skip - stop <= max_gap and j + skip - end <= max_gap:
                best = max(best, grow(k + 1, i + size, j + size, covered + size - skip))
        return best

    return max((grow(k + 1, i + s, j + s, s) for k, (i, j, s) in enumerate(runs)), default=0)


def test_chains_are_the_best_ones():
    rng = random.Random(3)
    for _ in range(400):
        template = [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 12))]
        words = list(template)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = [rng.choice("abcdefghxyz") for _ in range(rng.randrange(3))]
        words = [rng.choice("abx") for _ in range(rng.randrange(3))] + words
        scanner = L.Scanner((("t", " ".join(template)),), {}, 2, 3, 0.75, {})
        score = scanner.scan(" ".join(words))[6]
        longest = covered_by_search(words, template, 2, 3) / len(template)
        # the automaton gives the longest run that ends at a place, so a chain of shorter ones may cover more
        assert score <= longest + 1e-9
        spans = scanner.scan(" ".join(words))[7]
        assert all(a[3] <= b[2] for a, b in zip(spans, spans[1:]))
        simple = len(set(template)) == len(template)
        if simple:
            assert abs(score - longest) < 1e-9


def test_words_of_the_template_in_a_gap_do_not_break_a_chain(spark):
    text = next(t for label, t in L.TEMPLATES if label == "bsd").split()
    for foreign in ("and use", "x y", "in source", "of conditions"):
        cut = " ".join([*text[:12], *foreign.split(), *text[12:]])
        found = by_id(L.license_scan(docs_of(spark, [cut])))[0]
        assert found.labels == "bsd" and found.score == 1.0


@pytest.mark.parametrize("label, text", L.TEMPLATES)
def test_every_notice_is_labelled(label, text):
    scanner = L.Scanner(L.TEMPLATES, L.BASE_PHRASES, 2, 3, 0.75)
    said = text.replace(" ", ", ").title()
    assert label in scanner.scan(f"Some file. {said}. And more of it.")[5].split(",")


@pytest.mark.parametrize("name, label", L.TAGS.items())
def test_tags_are_labelled_whole(name, label):
    scanner = L.Scanner(L.TEMPLATES, L.BASE_PHRASES, 2, 3, 0.75)
    assert label in scanner.scan(f"// SPDX-License-Identifier: {name.replace(' ', '-').upper()}")[5].split(",")
    assert scanner.scan("// SPDX-License-Identifier: Other")[5] == ""
