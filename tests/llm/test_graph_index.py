import math

import numpy as np
import pytest
from gradeframe.llm import graph_index as G
from pyspark.sql import functions as F

import __spark_entry__ as entry

SCHEMA = "vec_id long, embedding array<float>, label int"


def restated(rows, k=20):
    """The nearest by comparing all; vectors that take no part left out."""
    good = [
        (i, np.array(v, dtype=np.float64))
        for i, v, *_ in rows
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    ]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-float(v @ w), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(df, **options):
    got = {}
    for r in G.nearest(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items()) / sum(
        map(len, want.values())
    )


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = restated(rows)
    got = {}
    for r in entry.queries()["op4_graph_search"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) > 0.97
    scores = {(i, j): s for i, w in want.items() for j, s in w}
    for i, hits in got.items():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0])) and i not in [j for j, _ in hits]
        assert all(abs(scores[i, j] - s) < 1e-9 for j, s in hits if (i, j) in scores)


@pytest.mark.parametrize("query_chunk", [3, 20_000])
def test_long_and_short_vectors_in_several_shards(spark, query_chunk):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 5)).tolist(), 0) for i in range(600)]
    got = found(spark.createDataFrame(rows, SCHEMA), shard_rows=100, min_shards=2, query_chunk=query_chunk)
    rows = [(i, np.float32(v).tolist(), 0) for i, v, _ in rows]
    want = restated(rows)
    assert recall(got, want) > 0.95


def test_one_graph_of_clusters_finds_its_way():
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(size=(150, 16)) + 30 * rng.normal(size=16) for _ in range(12)]).astype(np.float32)
    entries, edges = G.build_graph(points, degree=16, beam=32)
    ids, _ = G.beam_search(points, edges, entries, points[::7], 32)
    d = ((points[::7, None] - points[None]) ** 2).sum(axis=2)
    want = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(want, ids[:, :10])]) > 0.95
    assert edges.shape == (1800, 16) and not (edges == np.arange(1800)[:, None]).any()


def test_copies_ties_and_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0], 0) for i in range(70)]
    rows += [(100 + i, [float(i % 3), 2.0], 0) for i in range(9)]
    rows += [(200, None, 0), (220, [], 0), (240, [0.0, 0.0], 0), (260, [None, 1.0], 0), (280, [nan, 1.0], 0)]
    rows += [(300, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (320, [1.0, 2.0, 3.0], 0), (340, [2.0, 1.0, 0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as point", "2 as size", "3 as v", "4 as shard")
    assert found(df) == restated(rows)
    assert found(df.limit(0)) == {}
    assert found(df.where("vec_id = 20")) == {}


@pytest.mark.parametrize("norm", [1e4, 2e19])
def test_a_few_very_long_vectors_among_short_ones(spark, norm):
    rng = np.random.default_rng(9)
    short = rng.normal(size=(600, 8))
    rows = [(i, (v / np.linalg.norm(v)).tolist(), 0) for i, v in enumerate(short)]
    rows += [(1001 + i, (norm * rng.normal(size=8)).tolist(), 0) for i in range(3)]
    rows = [(i, np.float32(v).tolist(), 0) for i, v, _ in rows]
    got = found(spark.createDataFrame(rows, SCHEMA), min_shards=2)
    assert recall(got, restated(rows)) > 0.97
