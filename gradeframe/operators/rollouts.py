"""Sampled decisions: counts, examples, the diversity filter and rewards."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.metrics import ratio
from gradeframe.functions.parsing import decision, reward
from gradeframe.schemas import require_columns


def rollout_counts(
    rollouts: DataFrame,
    key: Sequence[str],
    text: str = "rollout",
    attempt: str = "attempt",
    examples: bool = True,
) -> DataFrame:
    """Decisions of each class per key, with the first text of either class in attempt order.

    Equal attempt numbers are ordered by text; a class without rollouts has an empty example.
    """
    require_columns(rollouts, [*key, text])
    columns = [F.col(text).alias("_text")]
    if examples:
        columns.append(F.col(attempt).alias("_attempt"))
    parsed = rollouts.select(*key, decision(F.col(text)).alias("_d"), *columns)

    def first(value: int) -> Column:
        order = F.struct("_attempt", "_text")
        found = F.min_by(F.when(F.col("_d") == value, F.col("_text")), F.when(F.col("_d") == value, order))
        return F.coalesce(found, F.lit("")).alias(f"example_{value}")

    return parsed.groupBy(*key).agg(
        F.count_if(F.col("_d") == 0).cast("int").alias("count_0"),
        F.count_if(F.col("_d") == 1).cast("int").alias("count_1"),
        F.count_if(F.col("_d") == -1).cast("int").alias("count_invalid"),
        *([first(0), first(1)] if examples else []),
    )


def rollout_counts_array(df: DataFrame, texts: str) -> DataFrame:
    """``rollout_counts`` for rows that hold all their rollouts in one array; no shuffle."""
    parsed = df.withColumn(
        "_parsed",
        F.transform(texts, lambda t: F.struct(decision(t).alias("d"), t.alias("t"))),
    )

    def of(value: int) -> Column:
        return F.filter("_parsed", lambda p: p["d"] == value)

    def example(value: int) -> Column:
        return F.coalesce(F.get(of(value), 0)["t"], F.lit(""))

    counts = {
        "count_0": F.size(of(0)),
        "count_1": F.size(of(1)),
        "count_invalid": F.size(of(-1)),
        "example_0": example(0),
        "example_1": example(1),
    }
    # A one-row generator: a later filter on the counts stays above it, so nothing is parsed twice.
    row = F.struct(*(column.alias(name) for name, column in counts.items()))
    rest = [c for c in df.columns if c not in counts]
    return parsed.select(*rest, F.inline_outer(F.array(row)))


def diversity_columns(counts: DataFrame) -> DataFrame:
    """Rollout counts under the names the diversified table carries."""
    return counts.withColumnsRenamed(
        {"count_1": "dfw_n_self", "count_0": "dfw_n_delegate", "count_invalid": "dfw_n_invalid"}
    ).drop("example_0", "example_1")


def diversified(counts: DataFrame) -> DataFrame:
    """Questions whose rollouts show both decisions."""
    return counts.filter((F.col("dfw_n_self") > 0) & (F.col("dfw_n_delegate") > 0))


def diversity_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Questions, kept questions and share, and the hand-off share among kept valid rollouts."""
    kept = (F.col("dfw_n_self") > 0) & (F.col("dfw_n_delegate") > 0)
    totals = counts.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if(kept).alias("n_kept"),
        F.coalesce(F.sum(F.when(kept, F.col("dfw_n_self"))), F.lit(0)).alias("kept_self"),
        F.coalesce(F.sum(F.when(kept, F.col("dfw_n_delegate"))), F.lit(0)).alias("kept_delegate"),
    )
    valid = F.col("kept_self") + F.col("kept_delegate")
    return totals.withColumn(
        "kept_pct", ratio(F.col("n_kept"), F.col("n_total")) * 100
    ).withColumn("delegate_pct", ratio(F.col("kept_delegate"), valid) * 100)


def with_reward(
    df: DataFrame, text: str = "completion", label: str = "is_correct", out: str = "reward"
) -> DataFrame:
    return df.withColumn(out, reward(F.col(text), F.col(label)))


def reward_report(rewarded: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Distribution of rewards per step; also runs as a streaming aggregation.

    A reward is +1 or -1, so the two counts hold all that the list of rewards holds.
    """
    return rewarded.groupBy(*by).agg(
        F.count("reward").alias("n"),
        F.count_if(F.col("reward") == 1.0).alias("n_plus"),
        F.count_if(F.col("reward") == -1.0).alias("n_minus"),
        F.avg("reward").alias("mean_reward"),
    )
