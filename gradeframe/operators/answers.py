"""Answers kept by what was asked.

The store holds one row per prompt hash, model and sample number in result folders behind a manifest. Equal
prompts of a run are asked once, and prompts that any earlier run asked of the same model are not asked again.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.functions.parsing import is_error
from gradeframe.operators.generation import ModelFn, balanced, model_outputs, needs_output
from gradeframe.operators.joins import latest_results, lookup_join
from gradeframe.schemas import require_columns
from gradeframe.sources import snapshots

STORE_KEY = ["prompt_id", "model", "sample"]


def prompt_id(prompt: Column) -> Column:
    """The hash by which a prompt's answers are kept."""
    return F.sha2(prompt, 256)


def stored_answers(spark: SparkSession, store: str, model: str) -> DataFrame | None:
    """``prompt_id, sample, generation, elapsed`` of a model: the newest good answer of each, else its newest error."""
    own = _own_rows(spark, store, model)
    if own is None:
        return None
    # dealt by prompt once: the newest of each sample, the samples of a prompt and joins by prompt need no other shuffle
    dealt = own.repartition("prompt_id")
    found = latest_results(dealt, STORE_KEY, is_error(F.col("generation")), snapshots.PLACE)
    return found.select("prompt_id", "sample", "generation", "elapsed")


def _own_rows(spark: SparkSession, store: str, model: str) -> DataFrame | None:
    rows = snapshots.read_snapshot(spark, store)
    return None if rows is None else rows.where(F.col("model") == model)


def compact_answers(spark: SparkSession, store: str) -> None:
    """The store as one folder with the newest good answer of each prompt, model and sample."""
    snapshots.compact(spark, store, STORE_KEY, lambda rows: is_error(F.col("generation")))


def _missing(prompts: DataFrame, stored: DataFrame | None, n: int, retry: str) -> DataFrame:
    """``prompt_id, prompt, samples``: the sample numbers of each prompt without an answer."""
    wanted = F.sequence(F.lit(0), F.lit(n - 1))
    if stored is None:
        return prompts.withColumn("samples", wanted)
    good = stored.where(~needs_output(F.col("generation"), retry) & (F.col("sample") < n))
    have = good.groupBy("prompt_id").agg(F.collect_set("sample").alias("have"))
    left = F.array_except(wanted, F.coalesce("have", F.array().cast("array<int>")))
    joined = prompts.join(have, "prompt_id", "left").withColumn("samples", F.sort_array(left)).drop("have")
    return joined.where(F.size("samples") > 0)


def ask_once(
    df: DataFrame,
    prompt: str,
    model_factory: Callable[[], ModelFn],
    store: str,
    model: str,
    n: int = 1,
    out: str = "generation",
    retry: str = "null_or_error",
    partitions: int | None = None,
    **options,
) -> DataFrame:
    """``df`` with an array of ``n`` texts per prompt, each distinct prompt asked once per sample and model.

    Answers are kept in ``store`` before they are used, so the result can be read any number of times and a
    later run asks for what is new only: other prompts, further samples, and errors unless ``retry="null_only"``.
    Rows with a null prompt get a null. Prompts are told apart by SHA-256.
    """
    require_columns(df, [prompt])
    spark = df.sparkSession
    keyed = df.withColumn("_prompt_id", prompt_id(F.col(prompt)))
    asked = keyed.where(F.col(prompt).isNotNull()).select(
        F.col("_prompt_id").alias("prompt_id"), F.col(prompt).alias("prompt")
    )
    prompts = asked.groupBy("prompt_id").agg(F.min("prompt").alias("prompt"))
    missing = _missing(prompts, stored_answers(spark, store, model), n, retry)
    run = uuid.uuid4().hex
    for count in range(1, n + 1):  # a model is asked for as many texts as a prompt lacks
        some = missing.where(F.size("samples") == count)
        if count < n and some.isEmpty():
            continue
        some = balanced(some, "prompt", partitions) if partitions else some
        answers = some.withColumn("_out", model_outputs(F.array("prompt"), model_factory, count, **options))
        each = F.explode(F.arrays_zip("samples", F.col("_out.generation").alias("g"), F.col("_out.elapsed").alias("e")))
        rows = answers.select("prompt_id", F.lit(model).alias("model"), each.alias("x")).select(
            "prompt_id", "model", F.col("x.samples").alias("sample"), F.col("x.g").alias("generation"),
            F.col("x.e").alias("elapsed"),
        )
        snapshots.replace_folder(rows, store, f"run={_next_run(spark, store)}/origin=ask-{run}/part={count}")
    found = stored_answers(spark, store, model).where(F.col("sample") < n)
    texts = F.sort_array(F.collect_list(F.struct("sample", "generation")))["generation"]
    arrays = found.groupBy("prompt_id").agg(texts.alias(out)).withColumnRenamed("prompt_id", "_prompt_id")
    # the rows behind the arrays are measured, which shuffles nothing
    rows = _own_rows(spark, store, model).where(F.col("sample") < n).select("prompt_id", "generation")
    return lookup_join(keyed.drop(out), arrays, ["_prompt_id"], "left", measure=rows).drop("_prompt_id")


def _next_run(spark: SparkSession, store: str) -> int:
    rows = snapshots.read_snapshot(spark, store)
    newest = None if rows is None else rows.agg(F.max("run")).first()[0]
    return 0 if newest is None else newest + 1
