"""Evaluations that grade raw answers on the way."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gradeframe.operators.grading import grade, grade_cells
from gradeframe.operators.reports import (
    before_after,
    capability_ratio,
    decision_report,
    decision_report_joined,
)
from gradeframe.schemas import one_of, require_columns


def evaluate_decisions(
    preds: DataFrame,
    decision: str = "decision",
    grade_mode: str = "column",
    label: str = "is_correct",
    answers: DataFrame | None = None,
    generations: str | None = None,
    domain: str | None = None,
    key: Sequence[str] = (),
    by: Sequence[str] = (),
    null_policy: str = "reference",
    unmatched: str = "fail",
) -> DataFrame:
    """Routing metrics with the labels from a column or from answers graded on the fly.

    In mode ``generations`` the answers table is matched to the predictions on ``key``; see
    ``decision_report_joined`` for predictions without exactly one answer row.
    """
    if one_of(grade_mode, ("column", "generations"), "grade_mode") == "column":
        return decision_report(preds, decision, label, by, null_policy=null_policy)
    if answers is None or generations is None or domain is None or not key:
        raise ValueError("grade_mode 'generations' needs answers, generations, domain and key")
    require_columns(answers, [*key, generations])
    truth = graded(answers, generations, domain).select(*key, "is_correct")
    return decision_report_joined(preds, truth, key, decision, "is_correct", by, null_policy, unmatched)


def graded(answers: DataFrame, generations: str, domain: str) -> DataFrame:
    """``is_correct`` from native arrays or, where the column is text, from foreign cells."""
    text = dict(answers.dtypes)[generations] == "string"
    return (grade_cells if text else grade)(answers, generations, domain)


def evaluate_capability(
    pre: DataFrame, post: DataFrame, generations: str, domain: str, by: Sequence[str] = ()
) -> DataFrame:
    """Share solved before and after training and their ratio, graded from raw answers."""
    return capability_ratio(
        before_after(graded(pre, generations, domain), graded(post, generations, domain), by), by=by
    )
