import hashlib
import random

import numpy as np
import pytest
from helpers import DOCS, docs_of
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Public

import __spark_entry__ as entry
from gradeframe.llm import bpe_tree as B
from gradeframe.llm.queries import TOKENIZER

PUBLIC = Public.from_file(TOKENIZER)
CONTENT = open(TOKENIZER, encoding="utf-8").read()
ENCODER = B.Encoder(CONTENT, leaf_bytes=8, window=2)


def public(text):
    return PUBLIC.encode(text or "", add_special_tokens=False).ids


ALPHABETS = ["ab", "e", "thein ", "<|endoftext|> x", "  \n\tx", "é中\U0001f600 a", "'re'll don't ", "0123456789", "\x00\x7f~"]


def samples(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        letters, n = rng.choice(ALPHABETS), rng.choice([1, 7, 60, 700])
        yield letters * n if rng.random() < 0.3 else "".join(rng.choice(letters) for _ in range(n))


def test_trees_equal_the_public_library():
    for text in samples(500, 1):
        assert ENCODER.encode(text) == public(text)
        assert ENCODER.decode(public(text)) == PUBLIC.decode(public(text), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_any_text_in_any_parts(text, size):
    pieces = list(ENCODER.parts(text, size))
    assert b"".join(p[2] for p in pieces).decode() == text
    ids = [ENCODER.tree(d) if single else ENCODER.encode(d.decode()) for _, single, d in pieces]
    assert ENCODER.join_parts([p[0] for p in pieces], ids) == public(text)
    assert ENCODER.decode(public(text)) == text


def test_parts_of_samples():
    for text in samples(300, 2):
        pieces = list(ENCODER.parts(text, 20))
        ids = [ENCODER.tree(d) if single else ENCODER.encode(d.decode()) for _, single, d in pieces]
        assert ENCODER.join_parts([p[0] for p in pieces], ids) == public(text)


def test_all_cuts_of_a_long_word():
    word = "antidisestablishmentarianism" * 3
    for at in range(len(word) + 1):
        halves = [ENCODER.merge(part.encode()) for part in (word[:at], word[at:])]
        assert ENCODER.join(*halves) == public(word)


def test_query_equals_the_public_library(spark, data):
    found = entry.queries()["op9_bpe"](spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        ids = public(texts[r.doc_id])
        decoded = PUBLIC.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("part_chars", [30, 1 << 16])
def test_long_texts_and_edge_cases(spark, part_chars):
    texts = [None, "", " ", "short", "x" * 3000, "some words here, " * 60, *samples(20, 3)]
    docs = docs_of(spark, texts, extra=["1 as part", "2 as _pieces", "3 as ids"])
    docs = docs.union(docs)
    tokenizer = B.Tokenizer(spark, TOKENIZER, leaf_bytes=16)
    found = tokenizer.encode(docs, part_chars=part_chars)
    assert sorted(found.columns) == sorted(docs.columns)
    rows = found.select("doc_id", "text", "part", "ids", tokenizer.decode("ids").alias("again")).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert list(r.ids) == public(r.text) and r.again == (r.text or "") and r.part == 1
    assert tokenizer.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_short_merges_equal_those_by_heap(monkeypatch):
    rng = random.Random(9)
    data = [t.encode()[: rng.randrange(1, 60)] for t in samples(400, 9)] + [b"aaaaaaa", b" the", b""]
    short = [ENCODER.merge_short(d) for d in data]
    monkeypatch.setattr(B, "SHORT_BYTES", 0)
    assert short == [ENCODER.merge(d) for d in data]


def test_words_in_use_outlive_the_bound():
    own = B.Encoder(CONTENT)
    own.plain("often")
    own.plain(" ".join(f"x{i}" for i in range(100_001)))
    assert "often" in own.known.older and len(own.known) <= 100_000
