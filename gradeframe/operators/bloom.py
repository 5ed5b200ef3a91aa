"""A Bloom filter of keys as a table of blocks, built and asked with built-in functions.

Every key falls into one block of eight 32-bit words and sets one bit in each. Blocks merge by OR, so they are
aggregated map-side, and the filter's size is set by its number of blocks and not by the number of keys. Rows whose key
is surely not in the set are told apart by a broadcast of the blocks, without a shuffle; the others may be in it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FractionalType

WORDS = 8
KEYS_PER_BLOCK = 16
#: Blocks of the largest filter: 200,000 rows of nine integers, about 16 MB as a broadcast table.
MAX_BLOCKS = 200_000


def _block(on: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(blocks).cast("long")).alias("_block")


def _masks(on: Sequence[str]) -> list[Column]:
    """One bit in each word, by five bits of a second hash."""
    second = F.xxhash64(F.lit("bits"), *on)
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(second, 5 * i).bitwiseAND(31).cast("int")) for i in range(WORDS)]


def key_filter(keys: DataFrame, on: Sequence[str], blocks: int) -> DataFrame:
    """Blocks that hold at least one key; keys with a null match nothing and are left out."""
    masks = [mask.alias(f"_w{i}") for i, mask in enumerate(_masks(on))]
    marked = keys.select(*on).na.drop(subset=list(on)).select(_block(on, blocks), *masks)
    return marked.groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)))


def with_maybe(df: DataFrame, found: DataFrame, on: Sequence[str], blocks: int, out: str = "_maybe") -> DataFrame:
    """``df`` and whether its key may be among the keys of the filter ``found``; false is certain."""
    words = [f"_w{i}" for i in range(WORDS)]
    hits = [F.col(w).bitwiseAND(mask) == mask for w, mask in zip(words, _masks(on))]
    every = hits[0]
    for hit in hits[1:]:
        every &= hit
    joined = df.withColumn("_block", _block(on, blocks)).join(F.broadcast(found), "_block", "left")
    return joined.withColumn(out, F.coalesce(every, F.lit(False))).select(*df.columns, out)


def blocks_for(keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> int | None:
    """Blocks for so many keys, which are counted up to what the largest filter holds; none for more."""
    most = max_blocks * KEYS_PER_BLOCK
    rows = keys.limit(most + 1).count()
    return max(1, -(-rows // KEYS_PER_BLOCK)) if rows <= most else None


def filtered_join(
    df: DataFrame, keys: DataFrame, on: Sequence[str], how: str, max_blocks: int = MAX_BLOCKS
) -> DataFrame | None:
    """``left_semi`` or ``left_anti`` join in which only rows that may have a match are shuffled.

    ``keys`` is read up to three times and may repeat. For an anti-join ``df`` is read twice, once for the rows that
    pass by the join. None, for an ordinary join, where the keys are more than the largest filter holds or are
    of types that equal values don't hash alike in.
    """
    kinds = [df.schema[k].dataType for k in on]
    alike = kinds == [keys.schema[k].dataType for k in on]
    if not alike or any(isinstance(kind, FractionalType) for kind in kinds):
        return None
    blocks = blocks_for(keys, max_blocks)
    if blocks is None:
        return None
    marked = with_maybe(df, key_filter(keys, on, blocks), on, blocks)
    wanted = keys.select(*on).distinct()
    joined = marked.where("_maybe").drop("_maybe").join(wanted, list(on), how).select(*df.columns)
    if how == "left_semi":
        return joined
    return marked.where("NOT _maybe").drop("_maybe").unionByName(joined)
