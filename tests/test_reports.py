import math

import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx
from gradeframe.operators import grading as G, reports as R
from gradeframe.plans.evaluation import evaluate_capability, evaluate_decisions

PAIRS = st.lists(st.tuples(st.sampled_from([1, 0, -1, None]), st.integers(0, 1)), min_size=1, max_size=60)


def restated(pairs):
    """The metrics again, from lists."""
    valid = [(d, t) for d, t in pairs if d != -1]

    def f1(cls):
        hit = sum(d == cls and t == cls for d, t in valid)
        wrong = sum(d == cls and t != cls for d, t in valid)
        miss = sum(d != cls and t == cls for d, t in valid)
        return 2 * hit / (2 * hit + wrong + miss) if 2 * hit + wrong + miss else 0.0

    solve = [t for d, t in valid if d == 1]
    hand = [t for d, t in valid if d == 0]
    p_s = sum(solve) / len(solve) if solve else 0.0
    p_d = sum(hand) / len(hand) if hand else 0.0
    z = 0.0
    if solve and hand:
        error = math.sqrt(p_s * (1 - p_s) / len(solve) + p_d * (1 - p_d) / len(hand))
        z = (p_s - p_d) / error if error > 0 else 0.0
    n = len(valid)
    return {
        "total_rows": len(pairs),
        "n_invalid": len(pairs) - n,
        "n_valid": n,
        "cds": z,
        "accuracy": sum(d == t for d, t in valid) / n if n else None,
        "ssr_pred": len(solve) / n if n else None,
        "ssr_true": sum(t for _, t in valid) / n if n else None,
        "macro_f1": (f1(0) + f1(1)) / 2,
        "base_solve_rate": sum(t for _, t in pairs) / len(pairs),
        "p_self": p_s,
        "p_delegate": p_d,
    }


@settings(max_examples=20, deadline=None)
@given(PAIRS)
def test_report_agrees_with_restated_metrics(spark, pairs):
    table = spark.createDataFrame([(d, t) for d, t in pairs], "decision int, is_correct int")
    got = R.decision_report(table).first().asDict()
    for name, value in restated(pairs).items():
        assert got[name] == (value if value is None else pytest.approx(value, abs=1e-9)), (name, pairs)


def test_null_decisions(spark):
    pairs = [(1, 1), (0, 0), (None, 1), (None, 0), (-1, 1), (1, 0)]
    table = spark.createDataFrame(pairs, "decision int, is_correct int")
    kept = R.decision_report(table).first()
    assert (kept["n_valid"], kept["n_invalid"], kept["accuracy"]) == (5, 1, 2 / 5)
    dropped = R.decision_report(table, null_policy="invalid").first()
    assert (dropped["n_valid"], dropped["n_invalid"], dropped["accuracy"]) == (3, 3, 2 / 3)
    assert R.valid_only(table).count() == 5


def test_no_valid_row_gives_null_rates(spark):
    table = spark.createDataFrame([(-1, 1)], "decision int, is_correct int")
    got = R.decision_report(table).first()
    assert got["accuracy"] is None and got["ssr_pred"] is None and got["cds"] == 0.0
    assert got["macro_f1"] == 0.0 and got["base_solve_rate"] == 1.0


def test_null_label_fails(spark):
    table = spark.createDataFrame([(1, None)], "decision int, is_correct int")
    with pytest.raises(PySparkException):
        R.decision_report(table).collect()


def labelled(spark, data):
    q = fx.questions(spark, data)
    return q.select("qid", "model", "decision", (F.col("qid") % 2).cast("int").alias("is_correct"))


def test_metamorphic_relations(spark, data):
    table = labelled(spark, data)
    whole = R.decision_report(table).first()
    swapped = table.withColumn("decision", F.when(F.col("decision") >= 0, 1 - F.col("decision")).otherwise(F.col("decision")))
    mirrored = R.decision_report(swapped).first()
    assert mirrored["cds"] == pytest.approx(-whole["cds"])
    both = swapped.withColumn("is_correct", 1 - F.col("is_correct"))
    assert R.decision_report(both).first()["macro_f1"] == pytest.approx(whole["macro_f1"])
    parts = R.decision_report(table, by=["model"])
    for name in ("total_rows", "n_invalid", "n_valid", "n_pred_self", "n_pred_delegate"):
        assert parts.agg(F.sum(name)).first()[0] == whole[name]


def test_joined_report_equals_the_row_wise_one(spark, data):
    table = labelled(spark, data)
    truth = table.select("qid", "is_correct")
    joined = R.decision_report_joined(table.drop("is_correct"), truth, ["qid"], by=["model"])
    assert rows(joined) == rows(R.decision_report(table, by=["model"]))
    repeated = table.drop("is_correct").unionByName(table.drop("is_correct"))
    twice = R.decision_report_joined(repeated, truth, ["qid"]).first()
    assert twice["total_rows"] == 2 * table.count()


def test_capability_ratio(spark):
    graded = spark.createDataFrame(
        [("a", "pre", 1), ("a", "pre", 0), ("a", "post", 1), ("b", "pre", 0), ("b", "post", 1)],
        "g string, phase string, is_correct int",
    )
    got = {r["g"]: (r["acc_pre"], r["acc_post"], r["capability_ratio"], r["count_mismatch"]) for r in R.capability_ratio(graded, by=["g"]).collect()}
    assert got == {"a": (0.5, 1.0, 200.0, True), "b": (0.0, 1.0, None, False)}


def test_evaluation_from_raw_answers(spark, data):
    answers = fx.answers(spark, data)
    preds = answers.select("qid", "model", "decision")
    from gradeframe.operators.grading import grade

    labels = grade(answers, "generation", "math")
    direct = evaluate_decisions(labels, by=["model"])
    graded = evaluate_decisions(
        preds, grade_mode="generations", answers=answers.drop("decision", "model"), generations="generation",
        domain="math", key=["qid"], by=["model"],
    )
    assert rows(direct) == rows(graded)
    cells = answers.withColumn("generation", F.to_json("generation"))
    same = evaluate_capability(answers, cells, "generation", "math", ["source"])
    assert {r["capability_ratio"] for r in same.collect()} == {100.0}
    with pytest.raises(ValueError):
        evaluate_decisions(preds, grade_mode="generations")


def test_value_counts_and_latency(spark):
    table = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert rows(R.value_counts(table, "v", normalize=True)) == [("a", 2, 0.6667), ("b", 1, 0.3333)]
    times = spark.createDataFrame([(i, float(i)) for i in range(5)], "row_id long, elapsed double")
    assert rows(R.latency_report(times, 3)) == [(2, 3.5)]


def test_predictions_without_one_label_fail_or_are_counted(spark):
    preds = spark.createDataFrame([(1, 1, "m"), (2, 0, "m"), (3, 1, "n")], "k int, decision int, model string")
    truth = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "k int, is_correct int")
    for some in ("k = 3", "k = 2"):
        with pytest.raises(Exception, match="label"):
            R.decision_report_joined(preds.filter(some), truth, ["k"]).collect()
    one = R.decision_report_joined(preds, truth, ["k"], unmatched="report").first()
    assert (one.total_rows, one.n_unmatched, one.n_repeated) == (1, 1, 1)
    each = R.decision_report_joined(preds, truth, ["k"], by=["model"], unmatched="report").collect()
    assert sorted((r.model, r.total_rows, r.n_unmatched, r.n_repeated) for r in each if r.model == "m") == [("m", 1, 0, 1)]
    assert [(r.n_unmatched, r.n_repeated) for r in each if r.model == "n"] == [(1, 0)]


def test_groupings_in_one_scan_equal_separate_reports(spark, capsys):
    from conftest import plan_of

    table = spark.createDataFrame(
        [(m, s, d, t) for i in range(60) for m, s, d, t in [(f"m{i % 3}" if i % 7 else None, f"s{i % 4}", [1, 0, -1, None][i % 4], i % 2)]],
        "model string, source string, decision int, is_correct int",
    )
    sets = [["model"], ["model", "source"], []]
    found = R.decision_report_sets(table, sets)
    accuracy = G.solve_accuracy_sets(table, sets)
    for group in sets:
        level = ",".join(group)
        for whole, one in ((found, R.decision_report(table, by=group)), (accuracy, G.solve_accuracy(table, group))):
            part = whole.filter(F.col("level") == level)
            assert rows(part.select(one.columns)) == rows(one)
            assert all(part.filter(F.col(c).isNotNull()).count() == 0 for c in ("model", "source") if c not in group)
    table.write.mode("overwrite").saveAsTable("some_decisions")
    assert plan_of(R.decision_report_sets(spark.table("some_decisions"), sets), capsys).count("FileScan") == 1
    spark.sql("DROP TABLE some_decisions")
