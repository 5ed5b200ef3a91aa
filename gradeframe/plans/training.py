"""Training tables: prompt and completion pairs, length filter, rollout prompts."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions import prompts as P
from gradeframe.functions.options import choices_text
from gradeframe.functions.parsing import checked_label, label_word
from gradeframe.functions.tokens import Counter, token_count
from gradeframe.operators.joins import select_analysis
from gradeframe.schemas import require_columns


def required_columns(domain: str, mode: str, analysis: str = "analysis") -> set[str]:
    """Columns a training table must have: what the templates of both turns name, and the label."""
    named = P.placeholders(P.train_template(domain, mode)) | P.placeholders(P.response_template(mode))
    columns = {"decision": "is_correct", "analysis": analysis}
    return {columns.get(name, name) for name in named}


def with_choices(df: DataFrame, out: str = "choices") -> DataFrame:
    """``df`` with ready choices text, made from ``options`` where they are present."""
    options = F.col("options") if "options" in df.columns else None
    choices = F.col("choices") if "choices" in df.columns else None
    return df.withColumn(out, choices_text(options, choices))


def _wrapped(prompt: Column, prefix: str, suffix: str) -> Column:
    return F.concat(F.lit(prefix), prompt, F.lit(suffix))


def render_pairs(
    df: DataFrame,
    domain: str,
    mode: str,
    user_prefix: str = "",
    user_suffix: str = "",
    eos: str = "",
    analysis: str = "analysis",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``prompt`` and ``completion`` of every row, other columns dropped unless in ``keep``.

    The prefix and suffix are the chat markup of the model to be trained.
    """
    require_columns(df, required_columns(domain, mode, analysis))
    choices = F.col("choices") if domain == "science" else None
    prompt = P.train_prompt(domain, mode, F.col("question"), choices)
    why = F.col(analysis) if mode != "label" else None
    response = P.train_response(mode, label_word(F.col("is_correct")), why)
    return df.select(
        *keep,
        _wrapped(prompt, user_prefix, user_suffix).alias("prompt"),
        F.concat(response, F.lit(eos)).alias("completion"),
    )


def render_prompts(
    df: DataFrame, domain: str, user_prefix: str = "", user_suffix: str = ""
) -> DataFrame:
    """``df`` plus the rollout ``prompt`` and a checked INT ``is_correct``."""
    require_columns(df, {"question", "is_correct"} | ({"choices"} if domain == "science" else set()))
    choices = F.col("choices") if domain == "science" else None
    query = P.query_text(domain, F.col("question"), None, choices)
    return df.withColumn(
        "prompt", _wrapped(P.rollout_prompt(query), user_prefix, user_suffix)
    ).withColumn("is_correct", checked_label(F.col("is_correct")))


def with_pair_tokens(
    pairs: DataFrame, counter: Callable[[], Counter] | None = None, out: str = "n_tokens"
) -> DataFrame:
    return pairs.withColumn(out, token_count(F.concat("prompt", "completion"), counter))


def fits(
    pairs: DataFrame, max_tokens: int, counter: Callable[[], Counter] | None = None
) -> DataFrame:
    """Pairs of at most ``max_tokens`` tokens, prompt and completion together."""
    counted = with_pair_tokens(pairs, counter, "_tokens")
    return counted.filter(F.col("_tokens") <= max_tokens).drop("_tokens")


def length_report(
    pairs: DataFrame, max_tokens: int, counter: Callable[[], Counter] | None = None
) -> DataFrame:
    """Pairs before the length filter, dropped by it and kept."""
    kept = F.col("_tokens") <= max_tokens
    return with_pair_tokens(pairs, counter, "_tokens").agg(
        F.count("*").alias("n_before"),
        F.count_if(~F.coalesce(kept, F.lit(False))).alias("n_dropped"),
        F.count_if(kept).alias("n_kept"),
    )


def token_length_report(
    df: DataFrame,
    column: str,
    counter: Callable[[], Counter] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Texts and their mean token count; nulls are skipped, no text gives 0."""
    require_columns(df, [column, *by])
    counted = df.select(*by, token_count(F.col(column), counter).alias("_tokens"))
    return counted.groupBy(*by).agg(
        F.count("_tokens").alias("n_texts"),
        F.coalesce(F.avg("_tokens"), F.lit(0.0)).alias("mean_tokens"),
    )


def build_sft(
    graded: DataFrame,
    pairs: DataFrame,
    domain: str = "math",
    mode: str = "teacher",
    max_tokens: int | None = None,
    counter: Callable[[], Counter] | None = None,
    row_id: str = "row_id",
    keep: Sequence[str] = (),
    spread_by: Sequence[str] | None = None,
    **markup,
) -> DataFrame:
    """Training pairs from graded questions and rationale pairs, cut to a length if one is given."""
    chosen = select_analysis(graded, pairs, row_id=row_id, spread_by=spread_by)
    rendered = render_pairs(chosen, domain, mode, keep=keep, **markup)
    return rendered if max_tokens is None else fits(rendered, max_tokens, counter)
