import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeframe.catalog import fixtures as fx
from gradeframe.catalog.registry import QUERIES
from gradeframe.operators import grading as G, reports as R, rollouts as D
from gradeframe.plans.training import render_pairs

PARSERS = ["parse_decision", "boxed_answer", "letter_answer", "normalise_gold", "grade_math_single", "sft_render"]


@pytest.mark.parametrize("name", PARSERS)
def test_projections_stay_in_the_jvm_and_move_nothing(spark, data, name, capsys):
    plan = plan_of(entry.queries()[name](spark, data), capsys)
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["grade_math_array", "grade_mcq_array"])
def test_array_grading_moves_nothing(spark, data, name, capsys):
    assert "Exchange" not in plan_of(entry.queries()[name](spark, data), capsys)


def test_report_has_one_exchange(spark, data, capsys):
    table = fx.questions(spark, data).withColumn("is_correct", F.lit(1))
    plan = plan_of(R.decision_report(table, by=["model"]), capsys)
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Python" not in plan


def test_patterns_are_evaluated_once(spark, data, capsys):
    for name, pattern, times in (
        ("grade_math_long", "(.*?)", 1),
        ("attempt_report", "(.*?)", 1),
        ("attempt_report_long", "(.*?)", 1),
        ("reward_report", "regexp_extract_all", 2),
        ("rollout_counts", "regexp_extract_all", 2),
        ("diversity_report", "regexp_extract_all", 2),
        ("rollouts_stub", "regexp_extract_all", 2),
        ("build_diversified_stub", "regexp_extract_all", 2),
    ):
        plan = plan_of(entry.queries()[name](spark, data), capsys)
        assert plan.count(pattern) == times, name


def test_scans_read_only_needed_columns(spark, data, capsys):
    plan = plan_of(entry.queries()["grade_math_long"](spark, data), capsys)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(schemas) == ["l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint", "o_orderkey:bigint"]
    counts = D.rollout_counts(fx.attempts(spark, data), ["qid"], examples=False)
    assert "l_linenumber" not in plan_of(counts, capsys)


def test_long_grading_counts_before_it_shuffles(spark, data, capsys):
    graded = G.grade_math_long(fx.questions(spark, data), fx.attempts(spark, data), ["qid"])
    plan = plan_of(graded, capsys)
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")
    assert re.search(r"hashpartitioning\(qid#\d+L, _pred#\d+", plan)


def test_rendering_is_one_projection(spark, data, capsys):
    plan = plan_of(render_pairs(fx.graded(spark, data), "science", "label"), capsys)
    assert plan.count("Project") == 1


def test_no_cross_joins(spark, data, capsys):
    for name in QUERIES:
        plan = plan_of(entry.queries()[name](spark, data), capsys)
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_model_calls_send_prompts_only_and_are_not_followed_by_a_shuffle(spark, data, capsys):
    for name in ("generate_with_errors", "generate_mcq_stub", "decide_stub", "rollouts_stub", "rationales_stub"):
        plan = plan_of(entry.queries()[name](spark, data), capsys)
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan, name
    plan = plan_of(entry.queries()["generate_stub"](spark, data), capsys)
    assert plan.count("Exchange") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange RoundRobinPartitioning")


def test_small_question_tables_are_broadcast(spark, data, capsys):
    scored = G.score_attempts(fx.questions(spark, data), fx.attempts(spark, data), ["qid"], ["attempt"])
    plan = plan_of(scored, capsys)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert plan.count("(.*?)") == 1
