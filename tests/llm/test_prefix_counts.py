import random

import public_tokenizers
import pytest
from helpers import DOCS, docs_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
from gradeframe.llm import prefix_counts as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
COUNTER = P.PrefixCounter(open(PATH, "rb").read())


def counts(text):
    return [0, *P._sums(COUNTER.steps(text)).tolist()]


def by_library(text):
    return [len(LIBRARY.encode(text[:n])) for n in range(len(text) + 1)]


ALPHABETS = ["ab", "the in", "        a", "▁ x", "=-*/", "0123 ", "é中\U0001f600 a", "\x00\t\n ", "oOаяв", "</s><0x41>"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_every_prefix_of_dense_texts(alphabet):
    rng = random.Random(alphabet)
    for n in (1, 2, 5, 30, 90):
        for _ in range(6):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert counts(text) == by_library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_every_prefix_of_any_text(text):
    assert counts(text) == by_library(text)


def test_every_prefix_of_vocabulary_runs():
    pieces = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choices(pieces, k=12))
        assert counts(text) == by_library(text)


def test_whole_text_as_one_segment_counts_the_same(monkeypatch):
    text = "Menteue que ciónquequeñ, the   thble-reingwh 42 = 1\n\n" * 3
    whole = P.SPACE + text.replace(" ", P.SPACE)
    assert COUNTER.counts(whole)[2:] == counts(text)[1:]
    assert "".join(COUNTER.segments.findall(whole)) == whole


def test_query_equals_the_library(spark, data):
    found = entry.queries()["op11_token_counts"](spark, data).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        n = len(LIBRARY.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


def test_budgets_and_cuts_from_stored_counts(spark):
    tokens = P.PrefixTokens(spark, PATH)
    texts = ["the thing in between", "aaaaaaaaaaaaaaaa    b", "\U0001f600\U0001f600", "", None]
    stored = tokens.with_prefixes(docs_of(spark, texts))
    limits = stored.crossJoin(spark.range(0, 12).withColumnRenamed("id", "n"))
    rows = limits.select(
        "text", "n", P.tokens_of_first("prefixes", "n").alias("first"), P.longest_within("prefixes", "n").alias("fits")
    ).collect()
    assert len(rows) == 60
    for r in rows:
        known = by_library(r.text or "")
        assert r["first"] == known[min(r.n, len(known) - 1)]
        assert r.fits == max(i for i, c in enumerate(known) if c <= r.n)
    cut = {r.doc_id: r.text for r in tokens.truncated(docs_of(spark, texts), 3).collect()}
    for i, text in enumerate(texts):
        known = by_library(text or "")
        want = text and text[: max(i for i, c in enumerate(known) if c <= 3)]
        assert cut[i] == want


def test_edge_cases(spark):
    texts = [None, "", " ", "x" * 5000, "中" * 2000, "a b " * 3000, "same", "same"]
    docs = docs_of(spark, texts, extra=["1 as n_tokens", "2 as prefixes", "3 as over_limit"])
    tokens = P.PrefixTokens(spark, PATH)
    found = tokens.token_counts(docs, 3).collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(LIBRARY.encode(r.text or ""))
        assert (r.n_tokens, r.over_limit, r.prefixes) == (n, n > 3, 2)
    assert tokens.token_counts(spark.createDataFrame([], DOCS), 3).count() == 0
    assert tokens.truncated(docs.withColumn("text", F.lit(None).cast("string")), 3).where("text is null").count() == 8
