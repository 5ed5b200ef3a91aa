"""Exact, reproducible samples and splits.

Rows are ordered by ``md5(seed|key)``. A cut of n rows is turned into a threshold on that hash,
found from narrow columns only: counts per hash prefix, which combine map-side to a few hundred
rows per group, locate the bucket in which the n-th row lies, and only that bucket is ranked. The rows themselves are then filtered where they are, so
no row is shuffled, whatever share of the table one group holds. ``key`` must be unique; a key
that repeats at a cut fails the query.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.operators.joins import BROADCAST_ROWS, lookup_join, settle_small
from gradeframe.schemas import require_columns
from gradeframe.session import reliable_checkpoint

DIGITS = 2
HASH_DIGITS = 32
BUCKET_ROWS = 200_000
LAST_HASH = "g"  # sorts after every hex digit


def hash_order(key: Sequence[str], seed: int) -> Column:
    """Sort key of the reproducible random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def _group(by: Sequence[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def _settled(df: DataFrame, max_groups: int) -> DataFrame:
    """A per-group table that later steps read without computing it again."""
    small = settle_small(df, max_groups)
    return reliable_checkpoint(df) if small is df else small


def _initial_targets(
    narrow: DataFrame, cuts: Sequence[int] | DataFrame, by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Counts per group and first hash digits, and the row each cut looks for."""
    counts = narrow.groupBy("_g", F.substring("_h", 1, DIGITS).alias("_b")).agg(
        F.count("*").alias("_c")
    )
    sizes = counts.groupBy("_g").agg(F.sum("_c").alias("_size"))
    if isinstance(cuts, DataFrame):
        wanted = cuts.select(_group(by).alias("_g"), F.lit(0).alias("cut"), F.col("n").cast("long"))
        sizes = sizes.join(wanted, "_g")
    else:
        pairs = [
            F.struct(F.lit(i).alias("cut"), F.lit(int(n)).cast("long").alias("n"))
            for i, n in enumerate(cuts)
        ]
        sizes = sizes.withColumn("_cut", F.explode(F.array(*pairs))).select(
            "*", "_cut.cut", "_cut.n"
        )
    found = F.least("n", "_size")
    return counts, sizes.select("_g", "cut", "n", found.alias("found"), found.alias("_nth"))


def _edge_buckets(counts: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per group and cut the bucket that holds the wanted row, and its place in that bucket."""
    earlier = (
        Window.partitionBy("_g", "cut").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = counts.join(targets, list(on)).withColumn(
        "_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))
    )
    inside = (F.col("_before") < F.col("_nth")) & (F.col("_before") + F.col("_c") >= F.col("_nth"))
    return runs.filter(inside).select(
        "_g",
        "cut",
        "n",
        "found",
        F.col("_b").alias("_prefix"),
        "_c",
        (F.col("_nth") - F.col("_before")).alias("_nth"),
    )


def hash_thresholds(
    df: DataFrame,
    key: Sequence[str],
    cuts: Sequence[int] | DataFrame,
    by: Sequence[str] = (),
    seed: int = 42,
    bucket_rows: int = BUCKET_ROWS,
    max_groups: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per group and cut the hash of its last row: ``_g``, ``cut``, ``n``, ``found``, ``last_hash``.

    ``cuts`` are row counts from the start of each group's order, numbered 0, 1, ..., or a table
    ``(*by, n)`` with one cut per group. ``found`` is less than ``n`` where the group is smaller.
    The hash prefix grows until the bucket with the wanted row is small enough to be ranked.
    """
    narrow = df.select(_group(by).alias("_g"), hash_order(key, seed).alias("_h"))
    counts, wanted = _initial_targets(narrow, cuts, by)
    targets = _settled(_edge_buckets(counts, wanted, ["_g"]), max_groups)
    digits = DIGITS
    while digits < HASH_DIGITS and (targets.agg(F.max("_c")).first()[0] or 0) > bucket_rows:
        pool = _inside(narrow, targets, digits)
        digits += DIGITS
        counts = pool.groupBy("_g", "_prefix", F.substring("_h", 1, digits).alias("_b")).agg(
            F.count("*").alias("_c")
        )
        targets = _settled(_edge_buckets(counts, targets.drop("_c"), ["_g", "_prefix"]), max_groups)

    in_bucket = Window.partitionBy("_g", "cut").orderBy("_h")
    exact = (
        narrow.withColumn("_prefix", F.substring("_h", 1, digits))
        .join(targets, ["_g", "_prefix"])
        .withColumn("_rank", F.row_number().over(in_bucket))
        .withColumn("_next", F.lead("_h").over(in_bucket))
        .filter(F.col("_rank") == F.col("_nth"))
    )
    repeated = F.raise_error(F.lit("the sampling key repeats"))
    last = F.when(F.col("_next") == F.col("_h"), repeated).otherwise(F.col("_h"))
    whole = F.col("found") < F.col("n")
    result = exact.select(
        "_g",
        "cut",
        "n",
        "found",
        F.when(whole, F.lit(LAST_HASH)).otherwise(last).alias("last_hash"),
    )
    return _settled(result, max_groups)


def _inside(narrow: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """Rows of the buckets that hold a wanted row."""
    wanted = targets.select("_g", "_prefix").distinct()
    return narrow.withColumn("_prefix", F.substring("_h", 1, digits)).join(
        wanted, ["_g", "_prefix"], "left_semi"
    )


def _with_cuts(
    df: DataFrame, thresholds: DataFrame, n_cuts: int, key: Sequence[str], by: Sequence[str], seed: int
) -> DataFrame:
    """``df`` with ``_h`` and one column ``_cut_i`` per cut."""
    if not by:
        last = {row["cut"]: row["last_hash"] for row in thresholds.collect()}
        return df.withColumns(
            {"_h": hash_order(key, seed)}
            | {f"_cut_{i}": F.lit(last.get(i)).cast("string") for i in range(n_cuts)}
        )
    per_group = thresholds.groupBy("_g").agg(
        *(
            F.max(F.when(F.col("cut") == i, F.col("last_hash"))).alias(f"_cut_{i}")
            for i in range(n_cuts)
        )
    )
    keyed = df.withColumn("_g", _group(by)).withColumn("_h", hash_order(key, seed))
    return lookup_join(keyed, per_group, ["_g"], "left", key, measure=thresholds).drop("_g")


def sample_n(
    df: DataFrame,
    n: int,
    key: Sequence[str],
    by: Sequence[str] = (),
    seed: int = 42,
    **limits,
) -> DataFrame:
    """Exactly ``n`` rows (of each group) without replacement; an error where there are fewer."""
    require_columns(df, [*key, *by])
    thresholds = hash_thresholds(df, key, [n], by, seed, **limits)
    if n > 0 and (not thresholds.take(1) or thresholds.filter("found < n").take(1)):
        raise ValueError(f"cannot take {n} rows: the table or one of its groups has fewer")
    cut = _with_cuts(df, thresholds, 1, key, by, seed)
    return cut.filter(F.col("_h") <= F.col("_cut_0")).drop("_h", "_cut_0")


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows in the reproducible random order; meant for the last step before a write."""
    return df.orderBy(hash_order(key, seed), *key)


def split_counts(
    df: DataFrame,
    n_train: int,
    n_test: int,
    key: Sequence[str],
    by: Sequence[str] = (),
    seed: int = 42,
    **limits,
) -> DataFrame:
    """First ``n_train`` rows (of each group) as ``train``, the next ``n_test`` as ``test``."""
    require_columns(df, [*key, *by])
    thresholds = hash_thresholds(df, key, [n_train, n_train + n_test], by, seed, **limits)
    cut = _with_cuts(df, thresholds, 2, key, by, seed)
    split = F.when(F.col("_h") <= F.col("_cut_0"), "train").when(
        F.col("_h") <= F.col("_cut_1"), "test"
    )
    return (
        cut.withColumn("split", split)
        .filter(F.col("split").isNotNull())
        .drop("_h", "_cut_0", "_cut_1")
    )


def stratum_quotas(
    df: DataFrame, by: Sequence[str], test_size: int, max_groups: int = BROADCAST_ROWS
) -> DataFrame:
    """Test rows per class, ``(*by, n)``: largest remainders, ties by class."""
    counts = settle_small(df.groupBy(*by).agg(F.count("*").alias("_c")), max_groups)
    total = counts.agg(F.sum("_c")).first()[0] or 0
    if test_size > total:
        raise ValueError(f"test_size {test_size} is larger than the table ({total} rows)")
    product = F.col("_c").cast("decimal(38,0)") * test_size
    shares = counts.select(
        *by,
        F.floor(product / max(total, 1)).cast("long").alias("n"),
        F.pmod(product, F.lit(max(total, 1)).cast("decimal(38,0)")).alias("_rest"),
    )
    left_over = test_size - (shares.agg(F.sum("n")).first()[0] or 0)
    ordered = shares.orderBy(F.desc("_rest"), *by)
    extra = ordered.limit(left_over).select(*by, F.lit(1).alias("_extra"))
    same = reduce(lambda a, b: a & b, (F.col(f"q.{c}").eqNullSafe(F.col(f"x.{c}")) for c in by))
    return (
        shares.alias("q")
        .join(extra.alias("x"), same, "left")
        .select(*(F.col(f"q.{c}") for c in by), (F.col("n") + F.coalesce("_extra", F.lit(0))).alias("n"))
    )


def stratified_split(
    df: DataFrame,
    by: Sequence[str],
    test_size: int,
    key: Sequence[str],
    seed: int = 42,
    max_groups: int = BROADCAST_ROWS,
    **limits,
) -> DataFrame:
    """All rows with ``split``: ``test_size`` test rows that keep the class shares, rest train."""
    require_columns(df, [*key, *by])
    quotas = settle_small(stratum_quotas(df, by, test_size, max_groups), max_groups)
    thresholds = hash_thresholds(df, key, quotas, by, seed, max_groups=max_groups, **limits)
    cut = _with_cuts(df, thresholds, 1, key, by, seed)
    split = F.when(F.col("_h") <= F.col("_cut_0"), "test").otherwise("train")
    return cut.withColumn("split", split).drop("_h", "_cut_0")


def union_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def filter_categories(df: DataFrame, categories: Sequence[str], column: str = "category") -> DataFrame:
    return df.filter(F.col(column).isin(*categories))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every named column is present."""
    return df.dropna(subset=list(columns))
