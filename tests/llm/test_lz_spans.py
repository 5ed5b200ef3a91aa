import hashlib
import random
import re

import duckdb
import pytest
from helpers import DOCS, docs_of, words

import __spark_entry__ as entry
from gradeframe.llm import lz_spans as L


def restated(rows, window):
    """Words left of each row by comparing all windows of all documents."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for at in range(len(w) - window + 1):
                key = tuple(w[at : at + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for at in range(len(w) - window + 1):
            if i is not None and first[tuple(w[at : at + window])] < i:
                gone |= set(range(at, at + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def found(docs, window, gram):
    return sorted(
        ((r.doc_id, r.n_words, r.n_removed, r.kept) for r in L.substring_dedup(docs, window, gram).collect()), key=str
    )


@pytest.mark.parametrize("window, gram, vocabulary", [(8, 3, 3), (8, 8, 6), (10, 4, 40), (50, 20, 500)])
def test_random_copies_equal_brute_force(spark, window, gram, vocabulary):
    rng = random.Random(window * 100 + gram)
    passages = [words(rng.randrange(window - 2, 3 * window), k, vocabulary) for k in range(8)]
    rows = []
    for i in range(70):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += words(rng.randrange(0, window), rng.random(), vocabulary)
            piece = list(rng.choice(passages))
            if rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = "changed"
            text += piece
        rows.append((rng.randrange(40) - 5, rng.choice([" ", "\n", " \t"]).join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, window, gram) == restated(rows, window)


def test_low_entropy_texts(spark):
    rows = [(3, "a " * 300), (1, "a " * 120), (2, "b " + "a " * 49), (0, "a b " * 60), (5, "b a " * 40), (6, "a " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, 50, 20) == restated(rows, 50)


def test_query_equals_its_twin(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    theirs = con.execute(entry.oracle_sql()["op10_lz_spans"])
    names = [d[0] for d in theirs.description]
    mine = entry.queries()["op10_lz_spans"](spark, data)
    assert sorted(tuple(r) for r in mine.select(*names).collect()) == sorted(theirs.fetchall())


def test_spans_and_digest(spark):
    text = " ".join(words(60, 1))
    rows = {r.doc_id: r for r in L.substring_dedup(docs_of(spark, [text, f"new {text} end"])).collect()}
    assert rows[1].kept == "new end" and [tuple(s) for s in rows[1].spans] == [(1, 61)] and rows[0].spans == []
    assert L.digest("new end") == hashlib.sha256(b"new end").hexdigest()


def test_edge_cases(spark):
    text = " ".join(words(55, 2))
    rows = [(7, text), (7, text), (None, text), (9, text), (8, None), (6, ""), (5, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as n_words", "2 as row_key", "3 as spans", "4 as seed")
    assert found(docs, 50, 20) == restated(rows, 50)
    assert found(docs, 50, 20)[0][:3] != (7, 55, 55)
    assert L.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0
