"""Evaluation reports: one row per group, computed in a single aggregation."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.metrics import discrimination, f1, ratio
from gradeframe.functions.parsing import INVALID, checked_label
from gradeframe.schemas import one_of, require_columns


def valid_only(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Rows whose decision is not -1; null decisions stay."""
    return df.filter(~F.col(decision).eqNullSafe(INVALID))


def decision_report(
    df: DataFrame,
    decision: str = "decision",
    label: str = "is_correct",
    by: Sequence[str] = (),
    weight: str | None = None,
    null_policy: str = "reference",
) -> DataFrame:
    """Routing metrics per group.

    ``null_policy="reference"`` keeps a null decision as a valid row that is always wrong;
    ``"invalid"`` counts it with -1. ``weight`` names a column of row counts for input that is
    already counted.
    """
    require_columns(df, [decision, label, *by])
    one_of(null_policy, ("reference", "invalid"), "null_policy")
    pred = F.col(decision)
    if null_policy == "invalid":
        pred = F.coalesce(pred, F.lit(INVALID))
    amount = F.col(weight) if weight else F.lit(1)
    rows = df.select(
        *by,
        pred.alias("_d"),
        checked_label(F.col(label)).alias("_t"),
        amount.cast("bigint").alias("_w"),
    )
    d, t = F.col("_d"), F.col("_t")
    valid = ~d.eqNullSafe(INVALID)
    solve, hand_off = d.eqNullSafe(1), d.eqNullSafe(0)

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_w")).otherwise(0)), F.lit(0)).alias(name)

    counts = rows.groupBy(*by).agg(
        total(F.lit(True), "total_rows"),
        total(~valid, "n_invalid"),
        total(valid, "n_valid"),
        total(solve, "n_pred_self"),
        total(hand_off, "n_pred_delegate"),
        total(solve & (t == 1), "_self_right"),
        total(hand_off & (t == 1), "_del_right"),
        total(hand_off & (t == 0), "_del_hit"),
        total(solve & (t != 1), "_self_fp"),
        total(hand_off & (t != 0), "_del_fp"),
        total(valid & (t == 1) & ~solve, "_self_fn"),
        total(valid & (t == 0) & ~hand_off, "_del_fn"),
        total(valid & d.eqNullSafe(t), "_agree"),
        total(valid & (t == 1), "_valid_true"),
        total(t == 1, "_true"),
    )
    c = F.col
    f1_self = f1(c("_self_right"), c("_self_fp"), c("_self_fn"))
    f1_delegate = f1(c("_del_hit"), c("_del_fp"), c("_del_fn"))
    return counts.select(
        *by,
        "total_rows",
        "n_invalid",
        F.coalesce(ratio(c("n_invalid"), c("total_rows")), F.lit(0.0)).alias("invalid_share"),
        "n_valid",
        "n_pred_self",
        "n_pred_delegate",
        F.coalesce(ratio(c("_self_right"), c("n_pred_self")), F.lit(0.0)).alias("p_self"),
        F.coalesce(ratio(c("_del_right"), c("n_pred_delegate")), F.lit(0.0)).alias("p_delegate"),
        discrimination(
            c("_self_right"), c("n_pred_self"), c("_del_right"), c("n_pred_delegate")
        ).alias("cds"),
        ratio(c("_agree"), c("n_valid")).alias("accuracy"),
        ratio(c("n_pred_self"), c("n_valid")).alias("ssr_pred"),
        ratio(c("_valid_true"), c("n_valid")).alias("ssr_true"),
        f1_self.alias("f1_self"),
        f1_delegate.alias("f1_delegate"),
        ((f1_self + f1_delegate) / 2).alias("macro_f1"),
        F.coalesce(ratio(c("_true"), c("total_rows")), F.lit(0.0)).alias("base_solve_rate"),
    )


def counted_sets(
    df: DataFrame, sets: Sequence[Sequence[str]], values: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Row counts ``_count`` per combination of ``values`` for several groupings at once, from one pass over the rows.

    ``sets`` lists the groupings, an empty one for all rows. Rows are counted by all columns first, so only counts are
    copied per grouping. ``level`` names the columns of a row's grouping, joined by commas; other grouping
    columns are null there, as are null groups of its own.
    """
    columns = list(dict.fromkeys(c for group in sets for c in group))
    require_columns(df, [*columns, *values])
    amount = F.sum(weight) if weight else F.count("*")
    counted = df.groupBy(*columns, *values).agg(amount.alias("_n"))
    used = [F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]
    level = F.concat_ws(",", *used) if columns else F.lit("")
    found = counted.groupingSets([[F.col(c) for c in (*group, *values)] for group in sets], *columns, *values)
    return found.agg(F.sum("_n").alias("_count"), level.alias("level"))


def decision_report_sets(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    decision: str = "decision",
    label: str = "is_correct",
    weight: str | None = None,
    null_policy: str = "reference",
) -> DataFrame:
    """``decision_report`` for several groupings, such as per model, per source and in total, in one scan.

    ``level`` tells the grouping of a row (see ``counted_sets``).
    """
    columns = list(dict.fromkeys(c for group in sets for c in group))
    counted = counted_sets(df, sets, [decision, label], weight)
    return decision_report(counted, decision, label, [*columns, "level"], "_count", null_policy)


def decision_report_joined(
    preds: DataFrame,
    truth: DataFrame,
    key: Sequence[str],
    decision: str = "decision",
    label: str = "is_correct",
    by: Sequence[str] = (),
    null_policy: str = "reference",
    unmatched: str = "fail",
) -> DataFrame:
    """``decision_report`` with the labels in a second table, one row per key.

    Predictions are counted per key, group and decision before the join, so a key with very
    many predictions reaches it as a handful of rows.

    A prediction whose key has no label, or more than one row of labels, ends the job (``unmatched="fail"``);
    with ``"report"`` such predictions are left out of the metrics and counted in the columns ``n_unmatched`` and
    ``n_repeated`` of their group.
    """
    one_of(unmatched, ("fail", "report"), "unmatched")
    key = list(key)
    require_columns(preds, [*key, decision, *by])
    counted = preds.groupBy(*key, *(b for b in by if b not in key), decision).agg(
        F.count("*").alias("_count")
    )
    labels = truth.groupBy(*key).agg(F.first(label).alias("_label"), F.count("*").alias("_labels"))
    joined = counted.join(labels, key, "left")
    if unmatched == "fail":
        checked = (
            F.when(F.col("_labels").isNull(), F.raise_error(F.lit("a prediction's key has no label")))
            .when(F.col("_labels") > 1, F.raise_error(F.lit("the key of a prediction has several labels")))
            .otherwise(F.col("_label"))
        )
        labelled = joined.withColumn("_label", checked)
        return decision_report(labelled, decision, "_label", by, "_count", null_policy)
    found = F.coalesce(F.col("_labels") == 1, F.lit(False))
    report = decision_report(joined.filter(found), decision, "_label", by, "_count", null_policy)
    group = [F.col(b).alias(f"_by_{b}") for b in by]
    missing = joined.groupBy(*group, F.lit(1).alias("_by_all")).agg(
        F.sum(F.when(F.col("_labels").isNull(), F.col("_count")).otherwise(0)).alias("n_unmatched"),
        F.sum(F.when(F.col("_labels") > 1, F.col("_count")).otherwise(0)).alias("n_repeated"),
    )
    same = F.lit(1) == F.col("_by_all")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    full = report.join(missing, same, "full")
    for b in by:
        full = full.withColumn(b, F.coalesce(b, f"_by_{b}"))
    return full.select(*report.columns, "n_unmatched", "n_repeated")


def capability_ratio(
    graded: DataFrame,
    phase: str = "phase",
    before: str = "pre",
    after: str = "post",
    by: Sequence[str] = (),
) -> DataFrame:
    """Share solved before and after per group and 100 * after / before.

    The ratio is null when nothing was solved before; ``count_mismatch`` tells unequal row counts.
    """
    require_columns(graded, [phase, "is_correct", *by])

    def side(name: str, prefix: str) -> list[Column]:
        here = F.col(phase) == name
        return [
            F.count_if(here & (F.col("is_correct") == 1)).alias(f"{prefix}_correct"),
            F.count_if(here & F.col("is_correct").isNotNull()).alias(f"{prefix}_n"),
        ]

    counts = graded.groupBy(*by).agg(*side(before, "pre"), *side(after, "post"))
    acc_pre = F.coalesce(ratio(F.col("pre_correct"), F.col("pre_n")), F.lit(0.0))
    acc_post = F.coalesce(ratio(F.col("post_correct"), F.col("post_n")), F.lit(0.0))
    return counts.select(
        *by,
        "pre_correct",
        "pre_n",
        acc_pre.alias("acc_pre"),
        "post_correct",
        "post_n",
        acc_post.alias("acc_post"),
        F.try_divide(acc_post * 100.0, acc_pre).alias("capability_ratio"),
        (F.col("pre_n") != F.col("post_n")).alias("count_mismatch"),
    )


def before_after(pre: DataFrame, post: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two graded tables as one table with a ``phase`` column, ready for ``capability_ratio``."""
    columns = [*by, "is_correct"]
    return pre.select(*columns, F.lit("pre").alias("phase")).unionByName(
        post.select(*columns, F.lit("post").alias("phase"))
    )


def value_counts(
    df: DataFrame, col: str, normalize: bool = False, digits: int = 4
) -> DataFrame:
    """Rows per value, nulls left out; with ``normalize`` also the rounded share of all of them."""
    present = df.filter(F.col(col).isNotNull())
    counts = present.groupBy(col).agg(F.count("*").alias("n"))
    if not normalize:
        return counts
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(ratio(F.col("n"), total), digits))


def generation_time(attempts: DataFrame, key: Sequence[str], elapsed: str = "elapsed") -> DataFrame:
    """Mean seconds over the attempts of a row."""
    return attempts.groupBy(*key).agg(F.avg(elapsed).alias("avg_generation_time"))


def after_warmup(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """Rows from position ``n`` on."""
    return df.filter(F.col(row_id) >= n)


def latency_report(
    df: DataFrame, warmup: int = 0, elapsed: str = "elapsed", row_id: str = "row_id"
) -> DataFrame:
    """Mean latency after the first ``warmup`` rows and the number of rows in it."""
    return after_warmup(df, warmup, row_id).agg(
        F.count(elapsed).alias("n"), F.avg(elapsed).alias("avg_latency")
    )
