"""Restartable runs: batch with an anti-join, or a stream over arriving files."""

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StringType, StructType

from gradeframe.operators.generation import unfinished
from gradeframe.operators.joins import latest_results, remaining
from gradeframe.operators.rollouts import reward_report, with_reward
from gradeframe.schemas import require_columns
from gradeframe.sources import snapshots
from gradeframe.sources.tables import append_results, read_results
from gradeframe.streaming.asked import known_keys, record_outcomes, state_in_rocks, to_ask

Job = Callable[[DataFrame], DataFrame]


def _outputs(output: str | Sequence[str]) -> list[str]:
    return [output] if isinstance(output, str) else list(output)


def _open(results: DataFrame, output: str | Sequence[str], retry: str) -> Column:
    """Whether any output of a row is still to be produced; a text or an array of texts each."""
    names = _outputs(output)
    require_columns(results, names)
    for name in names:
        kind = results.schema[name].dataType
        if not isinstance(getattr(kind, "elementType", kind) if isinstance(kind, ArrayType) else kind, StringType):
            raise ValueError(f"output {name!r} must hold texts or arrays of texts, not {kind.simpleString()}")
    return reduce(lambda a, b: a | b, (unfinished(results, name, retry) for name in names))


def _left(inputs: DataFrame, path: str, key: Sequence[str], output, retry: str, **limits) -> DataFrame:
    """Inputs without a good result below ``path``."""
    earlier = read_results(inputs.sparkSession, path)
    if earlier is None:
        return inputs
    return remaining(inputs, earlier.filter(~_open(earlier, output, retry)), key, **{"hot_rows": None} | limits)


def run_incremental(
    inputs: DataFrame,
    path: str,
    job: Job,
    key: Sequence[str],
    output: str | Sequence[str],
    retry: str = "null_or_error",
    slices: int = 1,
    **limits,
) -> DataFrame:
    """Apply ``job`` to inputs without a good result, append its rows, return the newest per key.

    ``key`` must be unique in ``inputs``. ``output`` names one or more columns of texts or arrays of texts;
    a row is done when all of them are. The inputs are cut into ``slices`` by a hash of the key, and each slice
    is kept as soon as it is done, so that a call which dies loses one slice at most; the next call takes up
    what is left. Every call writes folders of its own, also beside calls that run at the same time.
    """
    spark = inputs.sparkSession
    earlier = read_results(spark, path)
    run = 0 if earlier is None else (earlier.agg(F.max("run")).first()[0] or 0) + 1
    todo = _left(inputs, path, key, output, retry, **limits)
    origin = f"batch-{uuid.uuid4().hex}"
    piece = F.pmod(F.xxhash64(*key), F.lit(slices))
    for part in range(slices):
        done = job(todo if slices == 1 else todo.filter(piece == part))
        require_columns(done, list(key))
        _open(done, output, retry)  # what could not be resumed is refused before any model is called
        append_results(done, path, run, origin, part)
    return newest(spark, path, key, output, retry)


def newest(
    spark: SparkSession, path: str, key: Sequence[str], output: str | Sequence[str], retry: str = "null_or_error"
) -> DataFrame:
    """Newest good row per key of everything written below ``path``."""
    results = read_results(spark, path)
    found = latest_results(results, key, _open(results, output, retry), snapshots.PLACE)
    return found.drop("origin", "part")


def compact(
    spark: SparkSession, path: str, key: Sequence[str], output: str | Sequence[str], retry: str = "null_or_error"
) -> None:
    """Results below ``path`` as one folder with the newest good row per key, so that later runs read no history.

    Runs and streams may go on writing meanwhile. Old folders go with ``snapshots.vacuum``.
    """
    snapshots.compact(spark, path, key, lambda rows: _open(rows, output, retry))


def stream_incremental(
    spark: SparkSession,
    source: str,
    schema: StructType,
    path: str,
    job: Job,
    checkpoint: str,
    pattern: str = "*.parquet",
    max_files: int = 1000,
    ready: Callable[[DataFrame], DataFrame] | None = None,
    key: Sequence[str] = (),
    output: str | Sequence[str] = (),
    retry: str = "null_or_error",
) -> StreamingQuery:
    """Apply ``job`` to files as they arrive in ``source`` until none is left.

    Each micro-batch has a folder of its own, named after the checkpoint; a batch that is replayed after its
    folder was kept is not asked again, and touches no other run. With ``key`` and ``output`` the stream keeps a state
    per key: a key is asked once, and again in a later start if its answer failed; keys with a good result from
    another run are not asked. Results are read when the stream starts, by its batches never; these join one
    narrow row for each key that had a result then. A key that ``job`` gives no row for counts as asked. Start it
    again with the same checkpoint for later files.
    """
    keyed = bool(key and output)
    if keyed:
        record_outcomes(spark, path, key, lambda rows: _open(rows, output, retry))
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
    )
    rows = ready(stream) if ready else stream
    if keyed:
        rows = to_ask(rows, known_keys(rows.schema, path, key, spark, f"{checkpoint}/_known"), key)
    origin = f"stream-{sha256(checkpoint.encode()).hexdigest()[:32]}"

    def write(batch: DataFrame, batch_id: int) -> None:
        if f"run={batch_id}/origin={origin}/part=0" not in (snapshots.folders(spark, path) or []):
            # a task takes up several partitions of the state: each task starts a model, and a batch may be small
            rows = batch.coalesce(spark.sparkContext.defaultParallelism) if keyed else batch
            append_results(job(rows), path, batch_id, origin)

    with state_in_rocks(spark):
        return (
            rows.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def stream_reward_report(
    rollouts: DataFrame,
    path: str,
    checkpoint: str,
    text: str,
    label: str | Column,
    by: Sequence[str] = ("step",),
) -> StreamingQuery:
    """Reward counts per step over a stream of rollouts.

    Every micro-batch writes the steps it changed; ``newest_report`` reads the latest of each. The state is a
    few counts per step and is kept for ever: steps of a training run are bounded by its length.
    """
    truth = F.col(label) if isinstance(label, str) else label
    report = reward_report(with_reward(rollouts.withColumn("_label", truth), text, "_label"), by)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_results(batch, path, batch_id, "report")

    return (
        report.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_report(spark: SparkSession, path: str, by: Sequence[str] = ("step",)) -> DataFrame:
    return latest_results(read_results(spark, path), by, F.lit(False), ["run"]).drop("run", "origin", "part")
