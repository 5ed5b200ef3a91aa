import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx
from gradeframe.operators import grading as G

KEY = ["qid"]


@pytest.fixture(scope="module")
def answers(spark, data):
    return fx.answers(spark, data).cache()


def test_array_form_equals_long_form(spark, data, answers):
    array = G.with_attempt_counts(G.grade(answers, "generation", "math", keep_scores=True))
    each = G.explode_attempts(answers, "generation").filter("attempt IS NOT NULL")
    long = G.grade_math_long(answers, each.select("qid", "attempt", "generation"), KEY, counts=True)
    columns = ["qid", "is_correct", "n_correct", "n_attempts"]
    assert rows(array.select(columns)) == rows(long.select(columns))
    assert rows(G.attempt_report(array)) == rows(G.attempt_report_long(answers, each, KEY))


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_rows": 0, "hot_rows": 50, "hot_sample": 1.0}])
def test_scored_attempts_give_the_same_labels(answers, limits):
    each = G.explode_attempts(answers, "generation").filter("attempt IS NOT NULL")
    scored = G.score_attempts(answers, each.select("qid", "attempt", "generation"), KEY, ["attempt"], **limits)
    array = G.with_attempt_counts(G.grade(answers, "generation", "math", keep_scores=True))
    columns = ["qid", "is_correct", "n_correct", "n_attempts"]
    expected = array.filter("n_attempts > 0").select(columns)
    assert rows(G.grade_scores(scored, KEY).select(columns)) == rows(expected)


def test_mcq_array_form_equals_long_form(answers):
    array = G.grade(answers, "attempts", "science")
    each = G.explode_attempts(answers, "attempts").filter("attempt IS NOT NULL").select("qid", "attempts.*")
    long = G.grade_mcq_long(each, KEY)
    kept = array.filter(F.size("attempts") > 0).select("qid", "is_correct")
    assert rows(kept) == rows(long.select("qid", "is_correct"))


def test_partitioning_does_not_matter(answers):
    one = G.grade(answers.repartition(1), "generation", "math")
    many = G.grade(answers.repartition(13), "generation", "math")
    assert rows(G.source_report(one, ["model"])) == rows(G.source_report(many, ["model"]))


def test_collected_attempts_come_back_in_order(answers):
    each = G.explode_attempts(answers.select("qid", "generation"), "generation").filter("attempt IS NOT NULL")
    back = G.collect_attempts(each.repartition(7), KEY, ["generation"])
    expected = answers.filter(F.size("generation") > 0).select("qid", "generation")
    assert rows(back.select("qid", "attempts")) == rows(expected)


def test_collected_attempts_are_graded_like_the_long_form(spark):
    right, wrong = "\\boxed{7}", "\\boxed{8}"
    votes = [(1, None if i % 4 == 0 else i % 3, right if i < 3 else wrong) for i in range(10)]
    votes += [(2, 0, right)] * 3 + [(2, 0, wrong)] * 2
    attempts = spark.createDataFrame(votes, "qid long, attempt int, generation string")
    questions = spark.createDataFrame([(1, "7", "s"), (2, "7", "s")], "qid long, answer string, source string")
    long = G.grade_math_long(questions, attempts, KEY)
    collected = G.collect_attempts(attempts, KEY, ["generation"]).join(questions, "qid")
    assert rows(G.grade(collected, "attempts", "math").select("qid", "is_correct")) == rows(
        long.select("qid", "is_correct")
    )


def test_majority_and_empty_rules(spark):
    table = spark.createDataFrame(
        [(1, ["A", "A", "B"]), (2, ["A", "B"]), (3, []), (4, None), (5, ["A"])], "i int, texts array<string>"
    ).withColumn("a", F.transform("texts", lambda t: F.struct(F.lit("A").alias("correct_label"), t.alias("generation"))))
    got = {r["i"]: r["is_correct"] for r in G.grade(table, "a", "science").collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    math = spark.createDataFrame(
        [(1, ["no", "\\boxed{3}"], "3"), (2, [], "3"), (3, None, "3"), (4, ["\\boxed{3}"], None)],
        "i int, g array<string>, answer string",
    )
    assert {r["i"]: r["is_correct"] for r in G.grade(math, "g", "math").collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_long_form_keeps_boxless_attempts_apart(spark):
    questions = spark.createDataFrame([(1, ""), (2, "5"), (3, None), (4, "=")], "qid long, answer string")
    attempts = spark.createDataFrame(
        [(1, "no box"), (2, "\\boxed{5}"), (2, "\\boxed{ 5 }"), (2, "x"), (3, "no"), (4, "\\boxed{}"), (9, "\\boxed{1}")],
        "qid long, generation string",
    )
    got = {r["qid"]: tuple(r)[1:] for r in G.grade_math_long(questions, attempts, KEY, counts=True).collect()}
    assert got == {1: (0, 0, 1), 2: (1, 2, 3), 3: (0, 0, 1), 4: (0, 0, 1)}
    empty_gold = spark.createDataFrame([(1, "\\boxed{}")], "qid long, generation string")
    assert G.grade_math_long(questions, empty_gold, KEY).filter("qid = 1").first()["is_correct"] == 1


def test_reports_on_no_rows_and_null_sources(spark):
    graded = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "source string, is_correct int")
    assert rows(G.source_report(graded)) == [("a", 1, 2, 0.5)]
    empty = G.solve_accuracy(graded.filter("false"))
    assert rows(empty) == [(0, 0, 0.0)]
    bounds = spark.createDataFrame([(0, 0)], "n_attempts int, n_correct int")
    assert rows(G.attempt_bounds(bounds)) == [(0, 0, 0, 0.0)]


def test_arguments_are_checked(answers):
    with pytest.raises(ValueError):
        G.grade(answers, "absent", "math")
    with pytest.raises(ValueError):
        G.grade(answers, "generation", "history")
    with pytest.raises(ValueError):
        G.grade(answers, "generation", "math", "double")
