import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradeframe.operators import joins as J

KEYS = st.sampled_from(["hot", "a", "b", "c", None])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limits", [{}, {"max_broadcast_rows": 0}, {"max_broadcast_rows": 0, "hot_rows": 3, "hot_sample": 1.0}])
def test_every_route_gives_the_plain_join(spark, how, limits):
    left = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(60)] + [(60, None)], "i long, k string"
    )
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    got = J.lookup_join(left, lookup, ["k"], how, ["i"], **limits)
    plain = left.join(lookup, ["k"], how)
    assert sorted(got.columns) == sorted(plain.columns)
    assert rows(got.select(plain.columns)) == rows(plain)


def test_hot_keys_are_found_and_spread(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    hot = J.hot_keys(left, ["k"], hot_rows=50, sample=1.0).collect()
    assert [r["_copies"] for r in hot] == [7]
    assert J.hot_keys(left, ["k"], hot_rows=500, sample=1.0) is None
    many = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert 5 <= J.hot_keys(many, ["k"], hot_rows=10_000).first()["_copies"] <= 9
    twos = left.unionByName(left)
    assert len(J.hot_keys(twos, ["k"], hot_rows=1, max_keys=5, sample=1.0).collect()) == 5


def test_hot_rows_meet_their_lookup_in_several_tasks(spark, capsys):
    from conftest import plan_of

    left = spark.range(600).withColumn("k", F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")))
    lookup = spark.createDataFrame([("hot", 1), ("3", 2)], "k string, v int")
    limits = {"max_broadcast_rows": 0, "hot_rows": 50, "hot_sample": 1.0}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = J.lookup_join(left, lookup, ["k"], "left", ["id"], **limits)
        assert "_slot" in plan_of(joined, capsys)
        tasks = joined.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) >= 3 and sum(r["count"] for r in tasks) == 400


def test_size_check_counts_rows_and_bytes(spark):
    table = spark.createDataFrame([("x" * 100,), ("y",)], "t string")
    assert J.is_small(table)
    assert not J.is_small(table, max_rows=1)
    assert not J.is_small(table, max_bytes=100)


@settings(max_examples=8, deadline=None)
@given(st.lists(KEYS, max_size=12), st.lists(st.tuples(KEYS, st.integers(0, 1)), min_size=1, max_size=25))
def test_select_analysis_takes_the_first_pair(spark, pair_keys, questions):
    pairs = spark.createDataFrame(
        [(i, k, f"no{i}", f"yes{i}") for i, k in enumerate(pair_keys)],
        "row_id long, question string, label_0_analysis string, label_1_analysis string",
    ).repartition(3)
    graded = spark.createDataFrame(
        [(i, k, y) for i, (k, y) in enumerate(questions)], "qid long, question string, is_correct int"
    )
    first = {}
    for i, k in enumerate(pair_keys):
        first.setdefault(k, i)
    expected = []
    for i, (k, y) in enumerate(questions):
        place = first.get(k) if k is not None else None
        text = None if place is None else f"{'yes' if y else 'no'}{place}"
        expected.append((i, text, place is not None))
    for limits in ({}, {"max_broadcast_rows": 0, "hot_rows": 2, "hot_sample": 1.0}):
        got = J.select_analysis(graded, pairs, spread_by=["qid"], **limits)
        assert rows(got.select("qid", "analysis", "has_pair")) == sorted(expected, key=repr)


def test_latest_result_prefers_good_rows(spark):
    results = spark.createDataFrame(
        [("a", 0, "x"), ("a", 1, "Error: y"), ("b", 0, "Error: 1"), ("b", 1, "Error: 2"), ("c", 0, "p"), ("c", 2, "q")],
        "k string, run int, t string",
    )
    got = J.latest_results(results, ["k"], F.col("t").startswith("Error"), "run")
    assert rows(got.select("k", "t")) == [("a", "x"), ("b", "Error: 2"), ("c", "q")]


def test_alignment_and_truth(spark):
    preds = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)], "k int, decision int")
    truth = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 1), (5, 0)], "k int, is_correct int")
    assert rows(J.alignment_report(preds, truth, ["k"])) == [(1, 2, 1, 2)]
    assert rows(J.attach_truth(preds, truth, ["k"])) == [(1, 1, 1), (2, 0, 0), (2, 1, 0)]
    with pytest.raises(ValueError):
        J.attach_truth(preds, truth, ["absent"])
