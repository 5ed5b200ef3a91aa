"""Running a caller-supplied model function over a table of prompts."""

import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from gradeframe.functions.parsing import ERROR_PREFIX, is_error
from gradeframe.operators.joins import remaining
from gradeframe.schemas import one_of, require_columns

ModelFn = Callable[[list[str], int], list[list[str]]]
OUTPUTS = "array<struct<generation:string,elapsed:double>>"
LENGTH_BINS_PER_DOUBLING = 16


def choose_model(
    factories: Mapping[str, Callable[[], ModelFn]], provider: str
) -> Callable[[], ModelFn]:
    """The model factory registered under a provider name, in any case."""
    known = {name.lower(): factory for name, factory in factories.items()}
    return known[one_of(provider.lower(), sorted(known), "provider")]


def _answer(
    model: ModelFn, prompts: list[str], n: int, capture: bool, before: float = 0.0
) -> list[list[dict]]:
    """``n`` texts per prompt with the seconds spent on each, failed calls included.

    With ``capture``, a prompt whose reply fails or has another number of texts gets error texts; the other
    prompts of its call keep their replies. A call that fails as a whole is halved to find the prompts at fault.
    """
    start = time.monotonic()
    try:
        answers = list(model(prompts, n))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} replies to {len(prompts)} prompts")
        for i, texts in enumerate(answers):
            if texts is None or isinstance(texts, str) or len(texts) != n:
                many = 0 if texts is None or isinstance(texts, str) else len(texts)
                if not capture:
                    raise ValueError(f"{many} texts in a reply, {n} were asked for")
                answers[i] = [f"{ERROR_PREFIX}: {many} texts in the reply, {n} were asked for"] * n
    except Exception as problem:
        if not capture:
            raise
        spent = before + (time.monotonic() - start) / len(prompts)
        if len(prompts) > 1:
            half = len(prompts) // 2
            return [
                out
                for some in (prompts[:half], prompts[half:])
                for out in _answer(model, some, n, capture, spent)
            ]
        return [[{"generation": f"{ERROR_PREFIX}: {problem}", "elapsed": spent}] * n]
    spent = before + (time.monotonic() - start) / len(prompts)
    return [[{"generation": text, "elapsed": spent} for text in texts] for texts in answers]


def _chunks(rows: Iterable[list[str | None] | None], size: int) -> Iterator[list]:
    """Consecutive rows that hold ``size`` prompts together, or just above where rows hold several."""
    chunk, prompts = [], 0
    for row in rows:
        chunk.append(row)
        prompts += 0 if row is None else sum(p is not None for p in row)
        if prompts >= size:
            yield chunk
            chunk, prompts = [], 0
    if chunk:
        yield chunk


def model_outputs(
    prompts: Column,
    model_factory: Callable[[], ModelFn],
    n: int = 1,
    capture: bool = True,
    per_call: bool = False,
    batch_size: int = 64,
) -> Column:
    """``n`` outputs for each entry of a prompt array, in order; a null entry gives null outputs.

    ``model_factory`` is called once per task. Only the prompts travel to Python, and the outputs of
    each call travel back before the next one. With ``per_call`` every output is a separate call
    with its own time and its own error text.
    """

    def answer(flat: list[str], model: ModelFn) -> list[list[dict]]:
        if per_call:
            return [[_answer(model, [p], 1, capture)[0][0] for _ in range(n)] for p in flat]
        return _answer(model, flat, n, capture) if flat else []

    @F.pandas_udf(OUTPUTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        silent = [{"generation": None, "elapsed": None}] * n
        for lists in batches:
            for rows in _chunks(lists, batch_size):
                flat = [p for row in rows if row is not None for p in row if p is not None]
                ready = iter(answer(flat, model))
                yield pd.Series(
                    [
                        None
                        if row is None
                        else [out for p in row for out in (silent if p is None else next(ready))]
                        for row in rows
                    ],
                    dtype=object,
                )

    # A model call is not repeatable: the planner must neither copy nor move it.
    return run.asNondeterministic()(prompts)


def generate(
    df: DataFrame,
    prompt: str,
    model_factory: Callable[[], ModelFn],
    n: int = 1,
    out: str = "generation",
    partitions: int | None = None,
    retry: str = "null_or_error",
    timing: str = "avg_generation_time",
    balance: bool = False,
    **options,
) -> DataFrame:
    """``df`` with an array of ``n`` texts per prompt and their mean time in ``timing``.

    Where ``out`` exists already, only its missing or failed rows are asked. The result must be written before it is used twice, since a second use calls the model again.
    ``partitions`` spreads the prompts first: one call costs far more than moving a row. With ``balance`` it
    does so by their length, for tasks that cost alike and calls with prompts of similar length.
    """
    require_columns(df, [prompt])
    spread = df.repartition(partitions) if partitions and not balance else df
    if partitions and balance:
        spread = balanced(df, prompt, partitions)
    asked = F.array(prompt)
    if out in df.columns:
        asked = F.when(unfinished(df, out, retry), asked)
    run = spread.withColumn("_out", model_outputs(asked, model_factory, n, **options))
    fresh = {out: F.col("_out.generation"), timing: _mean(F.col("_out.elapsed"))}
    return run.withColumns(
        {
            name: F.when(F.col("_out").isNull(), F.col(name)).otherwise(value)
            if out in df.columns and name in df.columns
            else value
            for name, value in fresh.items()
        }
    ).drop("_out")


def _bin(length: Column) -> Column:
    """Lengths in steps of a few percent, at most some hundred of them."""
    return F.floor(F.log2(length + 1) * LENGTH_BINS_PER_DOUBLING).cast("int")


def balanced(df: DataFrame, prompt: str, partitions: int, cost: Column | None = None) -> DataFrame:
    """Rows dealt to ``partitions`` tasks that cost alike, prompts of similar length together and in order of length.

    ``cost`` (default: one and the length of the prompt) is summed per step of length; the whole cost is cut into equal
    parts along the steps, and a step that lies across a cut is split by chance, so many equal prompts spread
    as well. Only the sums, some hundred rows, reach the driver.
    """
    require_columns(df, [prompt])
    length = F.coalesce(F.length(prompt), F.lit(0))
    price = (length + 1).cast("double") if cost is None else cost.cast("double")
    sums = df.groupBy(_bin(length).alias("bin")).agg(F.sum(price).alias("cost")).collect()
    before, total = [], 0.0
    for row in sorted(sums):
        before.append((row["bin"], total, row["cost"]))
        total += row["cost"]
    if not total:
        return df.repartition(partitions)
    table = F.broadcast(df.sparkSession.createDataFrame(before, "_bin int, _before double, _cost double"))
    part = F.floor((F.col("_before") + F.rand(7) * F.col("_cost")) / total * partitions).cast("int")
    dealt = df.withColumn("_bin", _bin(length)).join(table, "_bin")
    dealt = dealt.withColumn("_part", F.least(part, F.lit(partitions - 1)))
    dealt = dealt.repartitionById(partitions, "_part").sortWithinPartitions(length)
    return dealt.select(*df.columns)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return F.try_divide(total, F.size(values))


def expand_attempts(df: DataFrame, n: int, out: str = "attempt") -> DataFrame:
    """``n`` rows per row, numbered from zero."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def expand_labels(df: DataFrame, out: str = "label") -> DataFrame:
    """Each row once for label 0 and once for label 1."""
    return df.withColumn(out, F.explode(F.array(F.lit(0), F.lit(1))))


def collapse_labels(
    df: DataFrame, key: Sequence[str], text: str, label: str = "label"
) -> DataFrame:
    """Back to one row per key with ``label_0_analysis`` and ``label_1_analysis``."""
    return df.groupBy(*key).agg(
        *(
            F.max(F.when(F.col(label) == value, F.col(text))).alias(f"label_{value}_analysis")
            for value in (0, 1)
        )
    )


def needs_output(value: Column, retry: str = "null_or_error") -> Column:
    """Whether a stored output is still to be produced."""
    one_of(retry, ("null_or_error", "null_only"), "retry")
    return value.isNull() if retry == "null_only" else value.isNull() | is_error(value)


def needs_outputs(values: Column, retry: str = "null_or_error") -> Column:
    """``needs_output`` for an array of texts: missing, or with a captured error in it."""
    one_of(retry, ("null_or_error", "null_only"), "retry")
    failed = F.coalesce(F.exists(values, is_error), F.lit(False))
    return values.isNull() if retry == "null_only" else values.isNull() | failed


def unfinished(df: DataFrame, output: str, retry: str = "null_or_error") -> Column:
    """Whether an output column of texts or arrays of texts is still to be produced."""
    array = isinstance(df.schema[output].dataType, ArrayType)
    return (needs_outputs if array else needs_output)(F.col(output), retry)


def pending(df: DataFrame, output: str, retry: str = "null_or_error") -> DataFrame:
    """Rows without an output, or with a captured error unless ``retry="null_only"``."""
    return df.filter(unfinished(df, output, retry))


def pending_keys(
    inputs: DataFrame,
    results: DataFrame,
    key: Sequence[str],
    output: str,
    retry: str = "null_or_error",
    **limits,
) -> DataFrame:
    """``pending`` for outputs kept in a table of their own."""
    done = results.filter(~unfinished(results, output, retry))
    return remaining(inputs, done, key, **limits)
