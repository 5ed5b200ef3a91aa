"""Model runs over question tables: answers, decisions, rollouts and rationales."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions import prompts as P
from gradeframe.functions.options import remapped_letter, reorder, shuffled_order
from gradeframe.functions.parsing import decision, label_word
from gradeframe.operators.generation import ModelFn, generate, model_outputs, needs_output
from gradeframe.operators.rollouts import diversified, diversity_columns, rollout_counts_array
from gradeframe.schemas import check_domain, ensure_column, one_of, require_columns

ModelFactory = Callable[[], ModelFn]


def _optional(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def domain_query(df: DataFrame, domain: str) -> Column:
    """Query text of a table's rows for a domain."""
    if check_domain(domain) == "math":
        return P.query_text("math", F.col("question"))
    return P.query_text(
        "science", F.col("question"), _optional(df, "options"), _optional(df, "choices")
    )


def answer_questions(
    questions: DataFrame,
    model_factory: ModelFactory,
    domain: str = "math",
    n: int = 5,
    out: str = "generation",
    **options,
) -> DataFrame:
    """``n`` answers per question as an array, to options in their given order for science.

    ``per_call=True`` makes each answer a call of its own, as hosted models need it.
    """
    prompt = P.answer_prompt(
        check_domain(domain),
        F.col("question"),
        _optional(questions, "options"),
        _optional(questions, "choices"),
    )
    prompted = questions.withColumn("_prompt", prompt)
    return generate(prompted, "_prompt", model_factory, n, out, **options).drop("_prompt")


def answer_mcq(
    questions: DataFrame,
    model_factory: ModelFactory,
    key: Sequence[str],
    n: int = 5,
    seed: int = 42,
    out: str = "attempts",
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """``n`` answers per question, each to another order of its options.

    The orders, prompts and results of a question stay in its row as arrays, so nothing is
    exploded and collected again.
    """
    require_columns(questions, [*key, "question", "options", "answer_index"])
    row_key = F.concat_ws("|", *(F.col(k).cast("string") for k in key))
    rounds = F.sequence(F.lit(0), F.lit(n - 1))
    spread = questions.repartition(partitions) if partitions else questions
    ordered = spread.withColumn(
        "_orders",
        F.transform(rounds, lambda a: shuffled_order(F.size("options"), row_key, a, seed)),
    )

    def prompt(order: Column) -> Column:
        return P.answer_prompt("science", F.col("question"), reorder(F.col("options"), order))

    prompted = ordered.withColumn("_prompts", F.transform("_orders", prompt))
    asked = prompted.withColumn(
        "_out", model_outputs(F.col("_prompts"), model_factory, 1, **options)
    )
    attempts = F.zip_with(
        "_orders",
        "_out",
        lambda order, o: F.struct(
            order.alias("shuffled_order"),
            remapped_letter(order, F.col("answer_index")).alias("correct_label"),
            o["generation"].alias("generation"),
        ),
    )
    return asked.withColumn(out, attempts).drop("_orders", "_prompts", "_out")


def decide(
    df: DataFrame,
    model_factory: ModelFactory,
    domain: str,
    binary_only: bool = False,
    decision_col: str = "decision",
    analysis_col: str = "analysis",
    **options,
) -> DataFrame:
    """One decision and its text per question."""
    prompted = df.withColumn("_prompt", P.decision_prompt(domain_query(df, domain), binary_only))
    run = generate(prompted, "_prompt", model_factory, 1, "_texts", timing="_seconds", **options)
    return (
        run.withColumn(analysis_col, F.get("_texts", 0))
        .withColumn(decision_col, decision(F.col(analysis_col)))
        .withColumn("elapsed", F.col("_seconds"))
        .drop("_prompt", "_texts", "_seconds")
    )


def rollouts(
    df: DataFrame,
    model_factory: ModelFactory,
    domain: str,
    k: int = 16,
    binary_only: bool = False,
    **options,
) -> DataFrame:
    """Decision counts and one example per class over ``k`` samples of each question."""
    prompted = df.withColumn("_prompt", P.decision_prompt(domain_query(df, domain), binary_only))
    run = generate(prompted, "_prompt", model_factory, k, "_texts", timing="_seconds", **options)
    return rollout_counts_array(run, "_texts").drop("_prompt", "_texts", "_seconds")


def diversity_counts(
    df: DataFrame, model_factory: ModelFactory, domain: str, k: int = 16, **options
) -> DataFrame:
    """Every question with its rollout counts; write it, then report on and filter it."""
    return diversity_columns(rollouts(df, model_factory, domain, k, **options))


def build_diversified(
    df: DataFrame, model_factory: ModelFactory, domain: str, k: int = 16, **options
) -> DataFrame:
    """Questions on which the samples show both decisions, with their counts."""
    return diversified(diversity_counts(df, model_factory, domain, k, **options))


def rationales(
    df: DataFrame,
    model_factory: ModelFactory,
    voice: str,
    out: str = "routing_analysis",
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """Rationale texts for rows that lack them or hold a captured error.

    ``self`` explains the row's own label in ``out``; ``teacher`` explains both labels in
    ``label_0_analysis`` and ``label_1_analysis``. Both prompts of a row share one pass.
    """
    one_of(voice, ("self", "teacher"), "voice")
    if voice == "self":
        require_columns(df, ["is_correct"])
        words = {out: label_word(F.col("is_correct"))}
    else:
        words = {"label_0_analysis": F.lit("DELEGATE"), "label_1_analysis": F.lit("SELF_SOLVE")}
    query = P.query_text_by_presence(F.col("question"), _optional(df, "options"))
    table = df.repartition(partitions) if partitions else df
    for name in words:
        table = ensure_column(table, name)
    asked = F.array(
        *(
            F.when(needs_output(F.col(name)), P.rationale_prompt(query, word, voice))
            for name, word in words.items()
        )
    )
    table = table.withColumn("_asked", asked).withColumn(
        "_out", model_outputs(F.col("_asked"), model_factory, 1, **options)
    )
    for i, name in enumerate(words):
        fresh = F.get("_out", i)["generation"]
        table = table.withColumn(name, F.when(F.get("_asked", i).isNotNull(), fresh).otherwise(F.col(name)))
    return table.drop("_asked", "_out")
