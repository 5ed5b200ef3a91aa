import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeframe.operators import answers as A
from gradeframe.operators.generation import generate


@pytest.fixture
def counted(tmp_path):
    """A model that notes every prompt it is asked, once per text; it refuses some until told otherwise."""
    log, mended = tmp_path / "calls", tmp_path / "mended"
    log.mkdir()

    def factory():
        def run(prompts, n):
            if any(p.startswith("bad") for p in prompts) and not mended.exists():
                raise RuntimeError("refused")
            for p in prompts:
                with open(log / hashlib.sha256(p.encode()).hexdigest(), "a") as file:
                    file.write("x" * n)
            return [[f"{p}|{i}" for i in range(n)] for p in prompts]

        return run

    factory.calls = lambda: sorted(len(f.read_text()) for f in log.iterdir())
    factory.mend = mended.touch
    return factory


def test_each_prompt_is_asked_once_per_sample(spark, tmp_path, counted):
    store = str(tmp_path / "store")
    table = spark.range(300).select(F.col("id"), F.concat(F.lit("p"), F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 10)).alias("p"))
    table = table.union(spark.createDataFrame([(1000, None)], "id long, p string"))
    for _ in range(2):  # the second run asks nothing
        found = A.ask_once(table, "p", counted, store, "m", 2)
        assert found.columns == ["id", "p", "generation"]
        assert rows(found) == rows(table.withColumn("generation", F.when(F.col("p").isNotNull(), F.array(F.concat("p", F.lit("|0")), F.concat("p", F.lit("|1"))))))
        assert counted.calls() == [2] * 10
    more = A.ask_once(table, "p", counted, store, "m", 5, partitions=3).collect()
    assert counted.calls() == [5] * 10 and all(len(r.generation) == 5 for r in more if r.p)
    A.compact_answers(spark, store)
    A.ask_once(table, "p", counted, store, "other", 1).collect()
    A.ask_once(table, "p", counted, store, "m", 1).collect()
    assert counted.calls() == [6] * 10


def test_errors_are_asked_again(spark, tmp_path, counted):
    store = str(tmp_path / "store")
    table = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "bad")], "id int, p string")
    first = A.ask_once(table, "p", counted, store, "m")
    assert rows(first.select("id", F.col("generation")[0])) == [(1, "good|0"), (2, "Error: refused"), (3, "Error: refused")]
    counted.mend()
    kept = A.ask_once(table, "p", counted, store, "m", retry="null_only")
    assert rows(kept.select("id", F.col("generation")[0])) == rows(first.select("id", F.col("generation")[0]))
    mended = A.ask_once(table, "p", counted, store, "m")
    assert rows(mended.select("id", F.col("generation")[0])) == [(1, "good|0"), (2, "bad|0"), (3, "bad|0")]
    assert counted.calls() == [1, 1]
    assert A.ask_once(table.limit(0), "p", counted, store, "m").count() == 0


def test_tasks_cost_alike_and_rows_are_unchanged(spark):
    # a few very long prompts, very many equal ones, and short ones
    table = spark.range(6000).select(
        "id",
        F.expr("repeat('x', CAST(CASE WHEN id % 500 = 0 THEN 20000 WHEN id % 3 = 0 THEN 900 ELSE id % 40 END AS INT))").alias("p"),
    )
    table = table.union(spark.createDataFrame([(-1, None), (-2, "")], "id long, p string"))
    dealt = A.balanced(table, "p", 8)
    assert rows(dealt) == rows(table) and dealt.columns == table.columns
    costs = dealt.groupBy(F.spark_partition_id().alias("t")).agg(F.sum(F.coalesce(F.length("p"), F.lit(0)) + 1).alias("c"))
    found = sorted(r.c for r in costs.collect())
    assert len(found) == 8 and found[-1] <= 1.5 * found[4]
    by_task = dealt.select(F.spark_partition_id(), F.coalesce(F.length("p"), F.lit(0))).collect()
    assert by_task == sorted(by_task, key=lambda r: (r[0], r[1]))
    assert A.balanced(table.limit(0), "p", 4).count() == 0


def test_generation_with_balanced_tasks(spark):
    def model():
        return lambda prompts, n: [[p.upper()] * n for p in prompts]

    table = spark.range(50).select("id", F.expr("repeat('a', CAST(id AS INT))").alias("p"))
    plain = generate(table, "p", model, 2)
    spread = generate(table, "p", model, 2, partitions=5, balance=True)
    assert rows(plain.select("id", "generation")) == rows(spread.select("id", "generation"))


def test_stored_answers_are_shuffled_once(spark, tmp_path, capsys):
    from conftest import plan_of

    from gradeframe.catalog import stubs

    store = str(tmp_path / "once")
    df = spark.createDataFrame([(i, f"p{i % 7}") for i in range(20)], "k int, p string")
    got = A.ask_once(df, "p", stubs.number_model, store, "stub", 2)
    assert got.count() == 20 and got.where("size(generation) = 2").count() == 20
    arrays = A.stored_answers(spark, store, "stub").groupBy("prompt_id").agg(F.collect_list("generation"))
    assert plan_of(arrays, capsys).count("Exchange hashpartitioning") == 1
