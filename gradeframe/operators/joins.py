"""Lookup joins that survive hot keys, and first/latest row per key.

A lookup has at most one row per key. When it is measured to be small it is broadcast.
Otherwise both sides are shuffled, and the few keys that hold very many rows of the large side
are spread over several tasks: their lookup row is copied once per task, and each row of the
large side meets exactly one copy.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    MapType,
    StringType,
    StructType,
    VariantType,
)

from gradeframe.functions.parsing import checked_label
from gradeframe.operators.bloom import filtered_join
from gradeframe.schemas import require_columns

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
HOT_ROWS = 2_000_000
HOT_KEYS = 10_000
HOT_SAMPLE = 0.01


def _row_bytes(df: DataFrame) -> Column:
    total = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            width = F.octet_length(field.name)
        elif isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType)):
            width = F.octet_length(F.to_json(field.name))
        else:
            width = F.lit(8)
        total = total + F.coalesce(width, F.lit(0)) + 16
    return total


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether the table was measured to stay within both limits; reads no more than needed."""
    sizes = df.select(_row_bytes(df).alias("n")).take(max_rows + 1)
    return len(sizes) <= max_rows and sum(row["n"] for row in sizes) <= max_bytes


def settle_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow aggregate as a broadcast table of its rows if few enough; else ``df`` itself."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def hot_keys(
    df: DataFrame,
    on: Sequence[str],
    hot_rows: int = HOT_ROWS,
    max_keys: int = HOT_KEYS,
    sample: float = HOT_SAMPLE,
) -> DataFrame | None:
    """Hashes of keys with about ``hot_rows`` rows and more, and the task count each needs.

    At most ``max_keys`` rows, the largest first; null when there is none. Only the keys are read
    and a sample of them counted: the outcome steers where rows go, never which rows there are.
    """
    keys = df.select(F.xxhash64(*on).alias("_key_hash"))
    if sample < 1:
        keys = keys.sample(sample, 7)
    counts = keys.groupBy("_key_hash").agg((F.count("*") / sample).alias("_rows"))
    found = (
        counts.filter(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"), "_key_hash")
        .limit(max_keys)
        .collect()
    )
    if not found:
        return None
    rows = [(r["_key_hash"], math.ceil(r["_rows"] / hot_rows)) for r in found]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "_key_hash long, _copies int"))


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    hot_rows: int | None = HOT_ROWS,
    max_broadcast_rows: int = BROADCAST_ROWS,
    measure: DataFrame | None = None,
    hot_sample: float = HOT_SAMPLE,
) -> DataFrame:
    """Join to a lookup with one row per key: ``inner``, ``left``, ``left_semi``, ``left_anti``.

    ``spread_by`` names the columns that tell rows of one key apart (default: all columns).
    ``hot_rows=None`` skips the search for hot keys, for a ``df`` whose keys cannot repeat.
    ``measure`` is a cheaper table that is never smaller than the lookup.
    """
    on = list(on)
    if is_small(lookup if measure is None else measure, max_broadcast_rows):
        return df.join(F.broadcast(lookup), on, how)
    hot = hot_keys(df, on, hot_rows, sample=hot_sample) if hot_rows else None
    if hot is None:
        return df.join(lookup, on, how)
    slot = F.pmod(F.xxhash64(*(spread_by or df.columns)), F.col("_copies")).cast("int")
    left = (
        df.withColumn("_key_hash", F.xxhash64(*on))
        .join(hot, "_key_hash", "left")
        .withColumn("_slot", F.coalesce(slot, F.lit(0)))
        .drop("_key_hash", "_copies")
    )
    copies = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    right = (
        lookup.withColumn("_key_hash", F.xxhash64(*on))
        .join(hot, "_key_hash", "left")
        .withColumn("_slot", F.explode(copies))
        .drop("_key_hash", "_copies")
    )
    joined = left.join(right, [*on, "_slot"], how).drop("_slot")
    return joined.select(*df.columns, *(c for c in joined.columns if c not in df.columns))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order, as an aggregate that combines map-side.

    ``order`` must tell the rows of a key apart.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*rest)
    rank = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    return df.groupBy(*key).agg(F.min_by(row, rank).alias("_row")).select(*key, "_row.*")


def latest_results(
    results: DataFrame, key: Sequence[str], error: Column, run: str | Sequence[str]
) -> DataFrame:
    """Newest good row per key; the newest failed one where a key has no good row.

    ``run`` names the run's number, and further columns that tell rows of one key and number apart.
    """
    number, *others = [run] if isinstance(run, str) else run
    failed = F.coalesce(error.cast("int"), F.lit(0))
    age = (-F.col(number)).alias("age")
    return first_per_key(results, key, [failed.alias("failed"), age, *others])


def attach_truth(
    preds: DataFrame,
    truth: DataFrame,
    key: Sequence[str],
    label: str = "is_correct",
    **limits,
) -> DataFrame:
    """Predictions with the label of their key; keys on one side only are left out.

    Run ``alignment_report`` to see such keys. Give ``measure`` where the truth is computed and
    not read, so that it is not computed once more to learn its size.
    """
    key = list(key)
    require_columns(preds, key)
    require_columns(truth, [*key, label])
    return lookup_join(preds, truth.select(*key, label), key, "inner", **limits)


def alignment_report(preds: DataFrame, truth: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: keys missing on either side and keys that repeat in the truth table."""
    key = list(key)
    sides = preds.select(*key, F.lit(1).alias("_p"), F.lit(0).alias("_t")).unionByName(
        truth.select(*key, F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    )
    per_key = sides.groupBy(*key).agg(F.sum("_p").alias("_p"), F.sum("_t").alias("_t"))
    return per_key.agg(
        F.count_if(F.col("_t") == 0).alias("keys_without_truth"),
        F.count_if(F.col("_p") == 0).alias("keys_without_prediction"),
        F.count_if(F.col("_t") > 1).alias("repeated_truth_keys"),
        F.count_if((F.col("_p") > 0) & (F.col("_t") > 0)).alias("matched_keys"),
    )


def restrict(df: DataFrame, keys: DataFrame, key: Sequence[str], bloom: bool = False, **limits) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``.

    With ``bloom``, rows whose key surely does not occur are dropped before the shuffle.
    """
    return _by_keys(df, keys, key, "left_semi", bloom, limits)


def remaining(inputs: DataFrame, results: DataFrame, key: Sequence[str], bloom: bool = False, **limits) -> DataFrame:
    """Input rows whose key has no result yet.

    With ``bloom``, rows whose key surely has none are not shuffled.
    """
    return _by_keys(inputs, results, key, "left_anti", bloom, limits)


def _by_keys(df: DataFrame, keys: DataFrame, key: Sequence[str], how: str, bloom: bool, limits: dict) -> DataFrame:
    wanted = keys.select(*key)
    if bloom and not is_small(wanted, limits.get("max_broadcast_rows", BROADCAST_ROWS)):
        found = filtered_join(df, wanted, key, how)
        if found is not None:
            return found
    return lookup_join(df, wanted.distinct(), key, how, **{"measure": wanted} | limits)


def select_analysis(
    graded: DataFrame,
    pairs: DataFrame,
    out: str = "analysis",
    row_id: str = "row_id",
    spread_by: Sequence[str] | None = None,
    **limits,
) -> DataFrame:
    """Rationale that fits each row's label, from the first pair of the same question text.

    Adds ``out`` and BOOLEAN ``has_pair``; questions without a pair get a null rationale.
    """
    require_columns(graded, ["question", "is_correct"])
    require_columns(pairs, ["question", "label_0_analysis", "label_1_analysis", row_id])
    narrow = pairs.select("question", "label_0_analysis", "label_1_analysis", row_id)
    first = first_per_key(narrow, ["question"], [row_id]).select(
        "question",
        F.col("label_0_analysis").alias("_text_0"),
        F.col("label_1_analysis").alias("_text_1"),
        F.lit(True).alias("has_pair"),
    )
    joined = lookup_join(graded, first, ["question"], "left", spread_by, measure=narrow, **limits)
    chosen = F.when(checked_label(F.col("is_correct")) == 1, F.col("_text_1")).otherwise(
        F.col("_text_0")
    )
    return (
        joined.withColumn(out, chosen)
        .withColumn("has_pair", F.coalesce("has_pair", F.lit(False)))
        .drop("_text_0", "_text_1")
    )


def unmatched_report(selected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and rows without a rationale pair, after ``select_analysis``."""
    return selected.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("has_pair")).alias("n_unmatched")
    )
