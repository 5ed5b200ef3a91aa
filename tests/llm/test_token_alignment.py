import hashlib
import random
from collections import Counter

import pytest
from helpers import DOCS, docs_of
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gradeframe.llm import token_alignment as A
from gradeframe.llm.queries import PIECES, TOKENIZER

LEFT = Tokenizer.from_file(TOKENIZER)
LEFT.encode_special_tokens = True
RIGHT = SentencePieceProcessor(model_file=PIECES)
SIDES = A.Sides(open(TOKENIZER, encoding="utf-8").read(), open(PIECES, "rb").read())


def ranges(text):
    """Ids and byte ranges of both sides by the public libraries; none where bytes differ."""
    if not text:
        return [], []
    data = (" " + text).encode()
    sides = []
    for ids, raw in (
        (LEFT.encode(" " + text, add_special_tokens=False).ids, SIDES.bytes_a),
        (RIGHT.encode(text), SIDES.bytes_b),
    ):
        if b"".join(raw[i] for i in ids) != data:
            return [], []
        at, found = 0, []
        for i in ids:
            found.append((i, at, at + len(raw[i])))
            at += len(raw[i])
        sides.append(found)
    return sides


def brute(texts):
    """The contract's columns, from overlaps of byte ranges."""
    aligned, total = [], Counter()
    for text in texts:
        a, b = ranges(text)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        said, low = [], 0
        for cut in cuts:
            inside = [",".join(str(x[0]) for x in side if low < x[2] <= cut) for side in (a, b)]
            said.append("|".join(inside))
            low = cut
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        total.update(links)
        aligned.append((len(a), len(b), said, links))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [
        (
            n_a, n_b, len(said), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links),
            hashlib.sha256(";".join(said).encode()).hexdigest() if said else "",
        )
        for n_a, n_b, said, links in aligned
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=60))
def test_groups_and_links_equal_brute_force(left, right):
    total = max(sum(left), sum(right))
    ends = [sorted({*(sum(x[: i + 1]) for i in range(len(x))), total} - {0}) for x in (left, right)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    found = []
    bounds, left, right = A.align(*ends)
    for i, i_end, j, j_end in bounds:
        if ends[0][i] == ends[1][j]:
            assert i_end - i == j_end - j
            found += ends[0][i:i_end]
        else:
            found.append(ends[0][i_end - 1])
    assert found == cuts
    pairs = set(zip(left, right))
    assert len(pairs) == len(left) == len(right)
    starts = [[0, *x[:-1]] for x in ends]
    assert pairs == {
        (i, j)
        for i in range(len(ends[0]))
        for j in range(len(ends[1]))
        if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]
    }


@pytest.mark.parametrize("equal", [0, 1, 2, 3, 7, 8, 9, 100, 1000])
def test_skipping_finds_the_first_difference(equal):
    x = list(range(equal)) + [10**6, 10**7]
    y = list(range(equal)) + [10**6 + 1, 10**7]
    assert A.first_difference([-1, *x], y, 1, 0) == equal
    assert A.first_difference(x, x, 0, 0) == len(x)


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    expected = dict(zip((r.doc_id for r in docs), brute([r.text if len(r.text or "") < 4_000 else None for r in docs])))
    short = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 4000")
    found = A.TokenAligner(spark, TOKENIZER, PIECES).valued(short.select("doc_id", "text")).collect()
    assert len(found) == short.count()
    for r in found:
        assert tuple(r[c] for c in COLUMNS) == expected[r.doc_id]
    whole = entry.queries()["op12_token_alignment"](spark, data)
    assert whole.columns == ["doc_id", *COLUMNS]
    lengths = {r.doc_id: ranges(r.text) for r in docs}
    rows = whole.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_a, r.n_b) == tuple(map(len, lengths[r.doc_id]))


@pytest.mark.parametrize("hot_share", [1, 3, 50, A.HOT_SHARE])
def test_edge_cases(spark, hot_share, monkeypatch):
    monkeypatch.setattr(A, "LINKS_PER_BATCH", 40)
    rng = random.Random(1)
    texts = [None, "", " ", "  a  b", "<|endoftext|> <s> </s>", "under▁score", "\x00\t\n é中\U0001f600", "same text", "same text"]
    texts += ["x" * 3000, "antidisestablishment " * 40, "中文" * 300]
    texts += ["".join(rng.choice("abé 中\n.") for _ in range(60)) for _ in range(30)]
    docs = docs_of(spark, texts, extra=["1 as number", "2 as row", "3 as a", "4 as n_best", "5 as best", "6 as times"])
    aligner = A.TokenAligner(spark, TOKENIZER, PIECES)
    found = aligner.valued(docs, hot_share=hot_share)
    assert sorted(found.columns) == sorted({*docs.columns, *COLUMNS} - {"text"})
    rows = found.orderBy("doc_id").collect()
    expected = brute(texts)
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == expected
    assert {(r.number, r.row, r.a, r.best, r.times) for r in rows} == {(1, 2, 3, 5, 6)}
    assert expected[4][0] > 0 and expected[5][0] == 0
    assert aligner.valued(spark.createDataFrame([], DOCS), hot_share=hot_share).count() == 0


def test_groups_of_a_text(spark):
    aligner = A.TokenAligner(spark, TOKENIZER, PIECES)
    texts = ["the antidisestablishment 中文", None, "a▁b"]
    rows = aligner.with_groups(docs_of(spark, texts, extra=["1 as groups", "2 as _row"])).orderBy("doc_id").collect()
    a, b = ranges(texts[0])
    for g in rows[0].groups:
        assert a[g.end_a - 1][2] == b[g.end_b - 1][2] and a[g.first_a][1] == b[g.first_b][1]
    assert sum(g.end_a - g.first_a for g in rows[0].groups) == len(a)
    assert len(rows[0].groups) == brute(texts)[0][2] and rows[0]["_row"] == 2
    assert not rows[1].groups and not rows[2].groups


def test_long_runs_are_told_apart():
    long = ["a" * 1000, "b c " + "é" * 1000 + " d", "a" + " " * 1000 + "b", "\n\x1c" * 500]
    assert all(map(A.has_long_run, long))
    assert not any(map(A.has_long_run, ["", "a" * 999, "a" * 999 + " " + "b" * 999, " " * 999 + "x" + " " * 999]))


def test_known_words_are_not_encoded_again(monkeypatch):
    sides = A.Sides(open(TOKENIZER, encoding="utf-8").read(), open(PIECES, "rb").read())
    assert sides.by_words
    monkeypatch.setattr(A, "KEPT_WORDS", 60)
    rng = random.Random(2)
    parts = ["a", "the", "ing", "é", "中", "'s", "12", "...", "\U0001f600", "<s>", " ", " ", " ", "  ", "\n", "\t", "\x1c", "▁"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2_000)]
    for text, (n_a, n_b, n_groups, n_links, *_, sha) in zip(texts, brute(texts)):
        found = sides.digest(text)
        assert (*found[:3], len(found[4]), found[3]) == (n_a, n_b, n_groups, n_links, sha)
    asked = []
    monkeypatch.setattr(A, "KEPT_WORDS", 1_000)
    monkeypatch.setattr(sides, "encode", lambda text, encode=sides.encode: asked.append(text) or encode(text))
    for text in ("some words stand here", "here some other words\nstand", "some other words", "here words stand"):
        sides.digest(text)
    assert asked == ["some words stand here", "other words\nstand"]
