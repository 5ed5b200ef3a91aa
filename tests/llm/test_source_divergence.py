import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from helpers import DOCS, words

import __spark_entry__ as entry
from gradeframe.llm import source_divergence as D


def brute(rows, min_docs=10, top=10):
    """The contract's rules over (lang, source, text)."""
    groups, docs_with = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups[lang, source].update(found)
        docs_with[lang].update(set(found))
    out = set()
    for lang in docs_with.keys() | {g[0] for g in groups}:
        kept = [t for t, n in docs_with[lang].items() if n >= min_docs]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + (10**9 * (counts[t] + 2)) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in own if o != s]
            over = [t for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            marks = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t) for t in over]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:top])):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def found_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, rows, extra=("1 as term", "2 as first", "3 as shard", "4 as id")):
    full = [(i, text, lang, source, len(text or "")) for i, (lang, source, text) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).selectExpr("*", *extra)


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("lang", "source", "text").collect()
    found = entry.queries()["op13_source_divergence"](spark, data)
    assert dict(found.dtypes) == {
        "lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"
    }
    assert found_of(found) == brute([tuple(r) for r in docs])


def test_small_blocks_and_hot_source(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = "hot" if i % 3 else f"s{rng.randrange(12)}"
        text = " ".join(words(rng.randrange(40), i, 90)) + rng.choice(["", " ÉCLAIR Éclair eclair", " x-y's 中文"])
        rows.append((rng.choice(["a", "b"]), source, text))
    expected = brute(rows)
    docs = table(spark, rows).repartition(7)
    assert found_of(D.divergence(docs)) == expected
    whole = D.frequencies(docs).collect()
    cut = D.frequencies(docs, postings=25, shards=3).collect()

    def plain(frequencies):
        return {(r.lang, r.term, r.n_docs, tuple(sorted(zip(r.sources, r.counts)))) for r in frequencies}

    assert plain(whole) == plain(cut) and len(whole) == len(cut)
    ids = [_array(1, 3, 2, 7, 5), _array(5, 1), _array(9), _array(2, 9, 3)]
    batch = pd.DataFrame(
        {"lang": list("abaa"), "ids": ids, "ps": [_array(*range(9, 9 + 50 * len(x), 50)) for x in ids],
         "nones": [x % 4 + 1 for x in ids]}
    )
    found = {}
    for cells, block in ((0, 2), (0, 512), (1 << 24, 512)):
        monkeypatch.setattr(D, "DENSE_CELLS", cells)
        monkeypatch.setattr(D, "PAIR_BLOCK", block)
        sums = pd.concat(D._corrections(iter([batch]))).groupby(["lang", "a", "b"])["value"].sum()
        found[cells, block] = {k: v for k, v in sums.items() if v}
    assert found[0, 2] == found[0, 512] == found[1 << 24, 512] and len(found[0, 2]) > 8


def _array(*numbers):
    import numpy as np

    return np.array(numbers, np.int64)


def test_edge_cases(spark):
    rows = [(None, None, "same words here")] * 12 + [("", "x", None)] * 3 + [("en", "one", "A a a-A " * 5)] * 11
    rows += [("en", "two", "a b")] * 10 + [("de", "only", "word")] * 10 + [("fr", "p", ""), ("fr", "q", "rare"), ("fr", None, "!")]
    rows += [("en", "three", "long " * 30_000), ("en", "bytes", "\x00b\x00 ab c")]
    found = found_of(D.divergence(table(spark, rows)))
    assert found == brute(rows)
    assert ("fr", "p", "pair", "q", 0, 2) in found or ("fr", "p", "pair", "q", 0, 1) in found
    assert D.divergence(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n,v", [(0, 1), (10**6, 10**5), (10**14, 10**9)])
def test_shares_are_exact_for_large_counts(spark, n, v):
    from pyspark.sql import functions as F

    counts = [0, 1, n // 3, n]
    df = spark.createDataFrame([(c, n, v) for c in counts], "c long, n long, v long")
    found = [r.p for r in df.select(D._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert found == [1 + (10**9 * (c + 2)) // (n + 2 * v) for c in counts]
