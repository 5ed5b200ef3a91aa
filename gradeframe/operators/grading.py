"""From model texts to one 0/1 label per question.

Array form (all attempts of a question in one row) is a projection without any shuffle.
Long form (one row per attempt) counts attempts map-side before anything is shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.cells import as_attempts, as_list, first_attempt_correct, ingest_cells
from gradeframe.functions.metrics import ratio
from gradeframe.functions.parsing import (
    BOX_MARK,
    boxed,
    gold_answer,
    math_correct,
    mcq_correct,
    strip,
)
from gradeframe.operators.joins import lookup_join
from gradeframe.operators.reports import counted_sets
from gradeframe.schemas import check_domain, one_of, require_columns


def gold_column(df: DataFrame, answer: str = "answer", source: str = "source") -> Column:
    """Stripped gold answer; the source rules apply where the table has a source column."""
    tag = F.col(source) if source in df.columns else None
    return strip(gold_answer(F.col(answer).cast("string"), tag))


def normalise_gold(df: DataFrame, answer: str = "answer", source: str = "source") -> DataFrame:
    """``answer`` rewritten by its source rule; unchanged without a source column."""
    if source not in df.columns:
        return df
    return df.withColumn(answer, gold_answer(F.col(answer).cast("string"), F.col(source)))


# ---- array form ----------------------------------------------------------------------------


def math_scores(texts: Column, gold: Column) -> Column:
    """0/1 per attempt of a text array. The gold answer is bound once, not once per attempt."""
    per_gold = F.transform(
        F.array(gold), lambda g: F.transform(texts, lambda text: math_correct(text, g))
    )
    return F.get(per_gold, 0)


def mcq_scores(attempts: Column) -> Column:
    """0/1 per attempt of an array of (correct_label, generation); malformed entries give 0."""
    return F.transform(
        attempts, lambda a: mcq_correct(a["generation"], a["correct_label"])
    )


def _total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0), lambda total, score: total + score)


def any_correct(scores: Column) -> Column:
    return F.exists(scores, lambda score: score == 1).cast("int")


def strict_majority(n_correct: Column, n: Column) -> Column:
    """1 when more than half of the votes are right; no vote gives 0."""
    return (n_correct >= F.floor(n / 2) + 1).cast("int")


def attempt_scores(df: DataFrame, generations: str, domain: str, out: str = "scores") -> DataFrame:
    """``df`` with the 0/1 array of its attempts; a null cell is an empty array."""
    require_columns(df, [generations])
    if check_domain(domain) == "math":
        scores = math_scores(F.col(generations), F.col("_gold"))
        scored = df.withColumn("_gold", gold_column(df)).withColumn(out, scores).drop("_gold")
    else:
        scored = df.withColumn(out, mcq_scores(F.col(generations)))
    return scored.withColumn(out, F.coalesce(out, F.array().cast("array<int>")))


def grade(
    df: DataFrame, generations: str, domain: str, mode: str = "multi", keep_scores: bool = False
) -> DataFrame:
    """``df`` plus INT ``is_correct``.

    ``multi``: any attempt right (math) or a strict majority right (science).
    ``single``: math takes one raw text, science one attempt struct.
    """
    require_columns(df, [generations])
    one_of(mode, ("single", "multi"), "mode")
    check_domain(domain)
    if mode == "single":
        if domain == "math":
            label = math_correct(F.col(generations), gold_column(df))
        else:
            label = mcq_correct(F.col(f"{generations}.generation"), F.col(f"{generations}.correct_label"))
        return df.withColumn("is_correct", label)
    scored = attempt_scores(df, generations, domain)
    label = (
        any_correct(F.col("scores"))
        if domain == "math"
        else strict_majority(_total(F.col("scores")), F.size("scores"))
    )
    graded = scored.withColumn("is_correct", label)
    return graded if keep_scores else graded.drop("scores")


def grade_cells(
    df: DataFrame, generations: str, domain: str, mode: str = "multi", fallback: bool = True
) -> DataFrame:
    """``grade`` for a table whose attempts are text cells of a foreign CSV.

    Adds ``parse_status`` next to ``is_correct``.
    """
    if check_domain(domain) == "math" and mode == "single":
        return grade(df, generations, domain, mode).withColumn("parse_status", F.lit("text"))
    read = ingest_cells(df, generations, "_value", fallback)
    if mode == "single":
        return read.withColumn("is_correct", first_attempt_correct(F.col("_value"))).drop("_value")
    shape = as_list if domain == "math" else as_attempts
    native = read.withColumn("_value", shape(F.col("_value")))
    return grade(native, "_value", domain, mode).drop("_value")


def explode_attempts(df: DataFrame, generations: str, position: str = "attempt") -> DataFrame:
    """One row per attempt with its zero-based position; a question without any keeps one row."""
    rest = [c for c in df.columns if c != generations]
    return df.select(*rest, F.posexplode_outer(generations).alias(position, generations))


def collect_attempts(
    attempts: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    attempt: str = "attempt",
) -> DataFrame:
    """All attempts of a question as one array in attempt order, null numbers first.

    A row holds every text of its question. For questions with more attempts than fit into a row, grade the
    long form, which never gathers texts.
    """
    key = list(key)
    entry = F.struct(F.col(attempt).alias(attempt), *columns)
    ordered = F.array_sort(F.collect_list(entry))
    if len(columns) == 1:
        ordered = F.transform(ordered, lambda e: e[columns[0]])
    return attempts.groupBy(*key).agg(ordered.alias("attempts"))


# ---- long form -----------------------------------------------------------------------------


def _answer_key(text: Column) -> Column:
    """Predicted answer as a join key that is never null: ``=answer``, or empty without a box.

    A key that could be null would make the planner add a null filter below the aggregation and
    so evaluate the patterns twice.
    """
    return F.coalesce(F.concat(F.lit("="), strip(boxed(text))), F.lit(""))


def _gold_key(questions: DataFrame) -> Column:
    return F.concat(F.lit("="), gold_column(questions))


def grade_math_long(
    questions: DataFrame,
    attempts: DataFrame,
    key: Sequence[str],
    text: str = "generation",
    counts: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Key, ``carry`` columns of the question, and ``is_correct`` of every question: 1 when any attempt matches its gold answer.

    Equal predictions of a question collapse map-side, and the join is on key *and* answer, so
    a question with very many attempts spreads over tasks. ``counts`` adds ``n_attempts`` and
    ``n_correct`` at the price of a second, smaller shuffle.
    """
    key = list(key)
    require_columns(questions, [*key, "answer"])
    # Only a boxed answer can be right; the other attempts matter for their number alone.
    used = attempts if counts else attempts.filter(F.col(text).contains(BOX_MARK))
    predictions = (
        used.select(*key, _answer_key(F.col(text)).alias("_pred"))
        .groupBy(*key, "_pred")
        .agg(F.count("*").alias("_n"))
    )
    golds = questions.select(*key, *carry, _gold_key(questions).alias("_pred"))
    graded = golds.join(predictions, [*key, "_pred"], "left").select(
        *key,
        *carry,
        F.col("_n").isNotNull().cast("int").alias("is_correct"),
        F.coalesce("_n", F.lit(0)).alias("n_correct"),
    )
    if not counts:
        return graded.drop("n_correct")
    totals = predictions.groupBy(*key).agg(F.sum("_n").alias("n_attempts"))
    return graded.join(totals, key, "left").select(
        *key, *carry, "is_correct", "n_correct", F.coalesce("n_attempts", F.lit(0)).alias("n_attempts")
    )


def score_attempts(
    questions: DataFrame,
    attempts: DataFrame,
    question_key: Sequence[str],
    keep: Sequence[str] = (),
    text: str = "generation",
    **limits,
) -> DataFrame:
    """``question_key``, ``keep`` columns and INT ``score`` of every attempt of a known question.

    For few questions with many attempts, of several models say: a small question table is
    broadcast and no attempt is shuffled. Only the parsed answer, never the text, goes further.
    """
    question_key = list(question_key)
    require_columns(questions, [*question_key, "answer"])
    golds = questions.select(*question_key, _gold_key(questions).alias("_gold"))
    columns = list(dict.fromkeys([*question_key, *keep]))
    predictions = attempts.select(*columns, _answer_key(F.col(text)).alias("_pred"))
    limits = {"measure": questions.select(*question_key, "answer")} | limits
    matched = lookup_join(predictions, golds, question_key, "inner", **limits)
    hit = F.coalesce((F.col("_pred") == F.col("_gold")).cast("int"), F.lit(0))
    return matched.select(*columns, hit.alias("score"))


def grade_scores(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attempts, right attempts and the any-correct label per key of scored attempts."""
    return scored.groupBy(*key).agg(
        F.count("*").alias("n_attempts"),
        F.sum("score").alias("n_correct"),
        F.max("score").alias("is_correct"),
    )


def grade_mcq_long(
    attempts: DataFrame,
    key: Sequence[str],
    text: str = "generation",
    gold_letter: str = "correct_label",
) -> DataFrame:
    """Key, ``n_attempts``, ``n_correct`` and the strict-majority label per question."""
    votes = attempts.groupBy(*key).agg(
        F.count("*").alias("n_attempts"),
        F.sum(mcq_correct(F.col(text), F.col(gold_letter))).alias("n_correct"),
    )
    return votes.withColumn("is_correct", strict_majority(F.col("n_correct"), F.col("n_attempts")))


def attempt_report_long(
    questions: DataFrame,
    attempts: DataFrame,
    key: Sequence[str],
    text: str = "generation",
    attempt: str = "attempt",
) -> DataFrame:
    """Per attempt number: right answers, attempts and their share (math, long form)."""
    key = list(key)
    predictions = (
        attempts.select(*key, attempt, _answer_key(F.col(text)).alias("_pred"))
        .groupBy(*key, "_pred", attempt)
        .agg(F.count("*").alias("_n"))
    )
    golds = questions.select(*key, _gold_key(questions).alias("_pred"), F.lit(1).alias("_hit"))
    matched = predictions.join(golds, [*key, "_pred"], "left")
    return _with_accuracy(
        matched.groupBy(attempt).agg(
            F.sum(F.when(F.col("_hit") == 1, F.col("_n")).otherwise(0)).alias("n_correct"),
            F.sum("_n").alias("n"),
        )
    )


# ---- reports -------------------------------------------------------------------------------


def _with_accuracy(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n")))


def attempt_report(scored: DataFrame, by: Sequence[str] = (), scores: str = "scores") -> DataFrame:
    """Per attempt number, over the rows that have it: right answers, attempts, share."""
    # The outer form keeps the planner from testing the array's size below, which would compute
    # the scores twice.
    long = scored.select(*by, F.posexplode_outer(scores).alias("attempt", "score")).filter(
        F.col("attempt").isNotNull()
    )
    return _with_accuracy(
        long.groupBy(*by, "attempt").agg(
            F.sum("score").alias("n_correct"), F.count("*").alias("n")
        )
    )


def attempt_bounds(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fewest and most attempts per row and the mean score over all attempts.

    Takes rows with ``n_attempts`` and ``n_correct``, questions without attempts included.
    """
    return counted.groupBy(*by).agg(
        F.min("n_attempts").cast("bigint").alias("min_attempts"),
        F.max("n_attempts").cast("bigint").alias("max_attempts"),
        F.sum("n_attempts").alias("n_scores"),
        F.coalesce(ratio(F.sum("n_correct"), F.sum("n_attempts")), F.lit(0.0)).alias("average"),
    )


def with_attempt_counts(scored: DataFrame, scores: str = "scores") -> DataFrame:
    return scored.withColumn("n_attempts", F.size(scores)).withColumn(
        "n_correct", _total(F.col(scores))
    )


def source_report(graded: DataFrame, by: Sequence[str] = (), source: str = "source") -> DataFrame:
    """Right answers, rows and share per source, in source order; null sources are left out."""
    report = (
        graded.filter(F.col(source).isNotNull())
        .groupBy(*by, source)
        .agg(F.sum("is_correct").cast("bigint").alias("n_correct"), F.count("is_correct").alias("n"))
    )
    return _with_accuracy(report).orderBy(*by, source)


def solve_accuracy_sets(graded: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``solve_accuracy`` for several groupings in one scan; ``level`` names the columns of each."""
    columns = list(dict.fromkeys(c for group in sets for c in group))
    counted = counted_sets(graded, sets, ["is_correct"])
    right = F.sum(F.when(F.col("is_correct") == 1, F.col("_count")).otherwise(0))
    rows = F.sum(F.when(F.col("is_correct").isNotNull(), F.col("_count")).otherwise(0))
    report = counted.groupBy(*columns, "level").agg(right.alias("n_correct"), rows.alias("n"))
    return report.withColumn("accuracy", F.coalesce(ratio(F.col("n_correct"), F.col("n")), F.lit(0.0)))


def solve_accuracy(graded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of right answers, their number and the row count; 0 on no rows."""
    report = graded.groupBy(*by).agg(
        F.coalesce(F.sum("is_correct"), F.lit(0)).cast("bigint").alias("n_correct"),
        F.count("is_correct").alias("n"),
    )
    return report.withColumn("accuracy", F.coalesce(ratio(F.col("n_correct"), F.col("n")), F.lit(0.0)))
