"""Token counts with a caller-supplied counter."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

Counter = Callable[[list[str]], list[int]]


def token_count(text: Column, counter: Callable[[], Counter] | None = None) -> Column:
    """Tokens of a text; null for a null text.

    ``counter`` makes, once per task, a function from a list of texts to their token counts.
    Without one, runs of non-space characters are counted, an approximation that stays in the JVM.
    """
    if counter is None:
        return F.regexp_count(text, F.lit(r"(?U)\S+"))

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count_texts = counter()
        for texts in batches:
            present = [text for text in texts if text is not None]
            lengths = iter(count_texts(present) if present else [])
            yield pd.Series(
                [None if text is None else next(lengths) for text in texts], dtype="Int64"
            )

    return count(text)
