import numpy as np
from helpers import DOCS, docs_of

import __spark_entry__ as entry
from gradeframe.llm import quality_trees as Q

LABELS = "doc_id long, quality int, toxic int"


def test_flat_trees_equal_node_by_node_walks():
    rng = np.random.default_rng(2)
    table = rng.normal(size=(800, len(Q.STATISTICS)))
    labels = ((table[:, 0] > 0.2) ^ (table[:, 3] > 0)).astype(float)
    trees = Q.grow(table, labels, rounds=30)

    def walk(row):
        total = trees.start
        for feature, border, value in zip(trees.feature, trees.border, trees.value):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + (2 if row[feature[node]] > border[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    scores = trees.score(table)
    assert np.allclose(scores, [walk(r) for r in table])
    assert ((scores > 0.5) == labels).mean() > 0.97
    assert trees.score(table[:0]).shape == (0,)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = entry.queries()["op6_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert right > 0.95 and wins > 0.97
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_held_out_rows_and_other_columns_never_teach(spark):
    texts = ["good plain text of words"] * 30 + ["!! || ## !!"] * 30
    docs = docs_of(spark, texts)
    rows = docs.select("doc_id", Q.held_out().alias("held")).collect()
    right = [(r.doc_id, int(r.doc_id < 30), 0) for r in rows if not r.held]
    wrong = [(r.doc_id, int(r.doc_id >= 30), 0) for r in rows if r.held]
    a = Q.quality(docs, spark.createDataFrame(right, LABELS), rounds=5, least=1.0)
    b = Q.quality(docs.withColumnRenamed("lang", "x"), spark.createDataFrame(right + wrong, LABELS), rounds=5, least=1.0)
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r.predicted for r in a.where("doc_id < 30").collect()} == {1}


def test_edge_cases(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, 0), (None, 0, 0), (3, 0, 0), (9, 1, 1)], LABELS)
    docs = docs_of(spark, [None, "", "x " * 50_000, "!!"], extra=["7 as score", "8 as predicted", "true as held_out"])
    docs = docs.unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    rows = Q.quality(docs, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    assert Q.quality(spark.createDataFrame([], DOCS), labels).count() == 0
    none = Q.quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    kept = Q.keep_good(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 8


def test_sample_bound_is_kept(spark):
    docs = docs_of(spark, [f"text {i}" for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    seen = []
    grow, Q.grow = Q.grow, lambda table, labels, **kw: seen.append(len(table)) or grow(table, labels, **kw)
    try:
        Q.fit(docs, labels, sample_rows=10)
    finally:
        Q.grow = grow
    assert seen == [10]
