"""Column helpers that keep costly expressions from being evaluated more than once."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters between words (ASCII and Latin-1 signs, general and CJK punctuation).
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\x{2000}-\x{206F}\x{3000}-\x{303F}]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    The optimizer copies a column's expression to each place that names it, also into lambdas, where it would be
    computed for every element. A lambda's own argument is never copied.
    """
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def normalised(text: str | Column) -> Column:
    """Lower-cased words with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN_WORDS, " "))
