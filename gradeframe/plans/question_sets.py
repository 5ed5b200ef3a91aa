"""Whole question sets: union, sampling and splits of several benchmark tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gradeframe.functions.options import encode_options
from gradeframe.operators.sampling import (
    drop_incomplete,
    filter_categories,
    sample_n,
    split_counts,
    stratified_split,
    union_sources,
)

# Fixed values.
SCIENCE_CATEGORIES = ("biology", "chemistry", "health", "physics")
LAST_TRAIN_YEAR = 2021


def build_math_set(
    gsm8k_train: DataFrame,
    gsm8k_test: DataFrame,
    math500: DataFrame,
    aime_train: DataFrame,
    aime_test: DataFrame,
    key: Sequence[str] = ("question",),
    gsm8k_sizes: tuple[int, int] = (1000, 300),
    math500_sizes: tuple[int, int] = (400, 100),
    last_year: int = LAST_TRAIN_YEAR,
    seed: int = 42,
) -> DataFrame:
    """Math questions with ``source`` and ``split``.

    The inputs have ``question`` and ``answer``, the older AIME set also ``year``. Order the
    result with ``shuffle_rows`` when it is written.
    """
    columns = list(dict.fromkeys([*key, "question", "answer"]))
    complete = ["question", "answer"]

    def tagged(df: DataFrame, source: str, split: str | None = None) -> DataFrame:
        df = df.select(*columns, *(["split"] if split is None else [])).withColumn("source", F.lit(source))
        return df if split is None else df.withColumn("split", F.lit(split))

    def sampled(df: DataFrame, n: int) -> DataFrame:
        return sample_n(drop_incomplete(df, complete), n, key, seed=seed)

    return union_sources(
        [
            tagged(sampled(gsm8k_train, gsm8k_sizes[0]), "GSM8K", "train"),
            tagged(sampled(gsm8k_test, gsm8k_sizes[1]), "GSM8K", "test"),
            tagged(split_counts(math500, *math500_sizes, key, seed=seed), "MATH500"),
            tagged(drop_incomplete(aime_train.filter(F.col("year") <= last_year), complete), "AIME", "train"),
            tagged(drop_incomplete(aime_test, complete), "AIME", "test"),
        ]
    )


def build_mcq_set(
    questions: DataFrame,
    test_size: int,
    key: Sequence[str],
    categories: Sequence[str] = SCIENCE_CATEGORIES,
    seed: int = 42,
    **limits,
) -> DataFrame:
    """Multiple-choice questions of some categories with JSON options and a stratified ``split``."""
    kept = filter_categories(questions, categories).drop("cot_content")
    encoded = kept.withColumn("options", encode_options(F.col("options")))
    return stratified_split(encoded, ["category"], test_size, key, seed, **limits)
