import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeframe.operators import bloom as B, joins as J


def tables(spark, n=4000, done=600):
    left = spark.range(n).select(F.concat(F.lit("q"), F.col("id")).alias("k"), (F.col("id") % 3).alias("j"), F.col("id").alias("v"))
    nulls = spark.createDataFrame([(None, 1, -1), ("q1", None, -2), (None, None, -3)], "k string, j long, v long")
    left = left.union(left.filter("v < 5")).union(nulls)
    right = spark.range(0, done * 5, 5).select(F.concat(F.lit("q"), F.col("id")).alias("k"), (F.col("id") % 3).alias("j"))
    right = right.union(right.limit(50)).union(spark.createDataFrame([(None, 1), ("zz", 2)], "k string, j long"))
    return left, right


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
@pytest.mark.parametrize("on", [["k"], ["k", "j"]])
def test_equal_to_the_plain_join(spark, how, on):
    left, right = tables(spark)
    found = B.filtered_join(left, right, on, how)
    assert found.columns == left.columns
    assert rows(found) == rows(left.join(right, on, how))
    for empty in (left.limit(0), right.limit(0)):
        some = (empty, right) if empty.columns == left.columns else (left, empty)
        assert rows(B.filtered_join(*some, on, how)) == rows(some[0].join(some[1], on, how))


def test_few_rows_without_a_match_reach_the_shuffle(spark):
    left, right = tables(spark, 20_000, 2_000)
    keys = right.select("k").distinct()
    blocks = B.blocks_for(keys)
    marked = B.with_maybe(left, B.key_filter(keys, ["k"], blocks), ["k"], blocks)
    matched = left.join(keys, ["k"], "left_semi").count()
    passed = marked.where("_maybe").count()
    assert matched <= passed <= matched + 0.03 * left.count()
    assert marked.where("_maybe").join(keys, ["k"], "left_semi").count() == matched


def test_the_filter_is_bounded_and_merges_map_side(spark, capsys):
    from conftest import plan_of

    left, right = tables(spark)
    assert B.blocks_for(right, max_blocks=3) is None
    assert B.filtered_join(left, right, ["k"], "left_anti", max_blocks=3) is None
    assert B.key_filter(right, ["k"], 7).count() <= 7
    plan = plan_of(B.key_filter(right, ["k"], 7), capsys)
    assert "partial_bit_or" in plan and "Python" not in plan
    # crowded blocks let more rows through and lose none
    crowded = B.with_maybe(left, B.key_filter(right, ["k"], 2), ["k"], 2)
    assert crowded.where("NOT _maybe").join(right, ["k"], "left_semi").count() == 0


def test_other_types_take_the_plain_join(spark):
    left = spark.range(10).withColumn("id", F.col("id").cast("int"))
    right = spark.range(5)
    assert B.filtered_join(left, right, ["id"], "left_anti") is None
    floats = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)], "x double")
    assert B.filtered_join(floats, floats, ["x"], "left_semi") is None
    assert rows(J.remaining(left, right, ["id"], bloom=True, max_broadcast_rows=0)) == [(i,) for i in range(5, 10)]


def test_remaining_and_restrict_with_the_filter(spark):
    left, right = tables(spark)
    for join in (J.remaining, J.restrict):
        plain = join(left, right, ["k"], max_broadcast_rows=0, hot_rows=None)
        found = join(left, right, ["k"], bloom=True, max_broadcast_rows=0)
        assert rows(found) == rows(plain)
