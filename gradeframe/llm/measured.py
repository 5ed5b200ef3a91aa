"""Broadcasts behind a check of the table's size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row of fixed-width columns, as Spark keeps it."""
    return 16 + 8 * len(df.columns)


def small_side(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it was counted and found small; its columns have fixed width.

    Counting stops at the bound. Larger tables stay as they are and are joined by a shuffle, with the same
    result. The table should be cheap to read, such as one that was just written.
    """
    rows = df.limit(BROADCAST_ROWS + 1).count()
    if rows <= BROADCAST_ROWS and rows * row_bytes(df) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df
