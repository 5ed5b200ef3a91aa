"""Fixed table schemas and plan-time schema checks."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

STR, INT, DBL = StringType(), IntegerType(), DoubleType()

MCQ_ATTEMPT = StructType(
    [
        StructField("shuffled_order", ArrayType(INT)),
        StructField("correct_label", STR),
        StructField("generation", STR),
    ]
)


def _table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


def _extend(base: StructType, **columns: DataType) -> StructType:
    return StructType(base.fields + _table(**columns).fields)


QUESTIONS_MATH = _table(question=STR, answer=STR, source=STR)
QUESTIONS_MCQ = _table(question=STR, options=ArrayType(STR), answer_index=INT, category=STR)
ANSWERS_MATH = _extend(QUESTIONS_MATH, generation=ArrayType(STR), avg_generation_time=DBL)
ANSWERS_MCQ = _extend(QUESTIONS_MCQ, attempts=ArrayType(MCQ_ATTEMPT))
GRADED_MATH = _extend(ANSWERS_MATH, is_correct=INT)
GRADED_MCQ = _extend(ANSWERS_MCQ, is_correct=INT)
RATIONALE_SELF = _table(question=STR, is_correct=INT, routing_analysis=STR)
RATIONALE_PAIRS = _table(question=STR, label_0_analysis=STR, label_1_analysis=STR)
TRAINING_ROWS = _table(question=STR, choices=STR, is_correct=INT, analysis=STR)
DECISIONS = _table(question=STR, decision=INT, analysis=STR)
ROLLOUT_COUNTS = _table(
    question=STR, count_0=INT, count_1=INT, count_invalid=INT, example_0=STR, example_1=STR
)
DIVERSIFIED = _table(question=STR, dfw_n_self=INT, dfw_n_delegate=INT, dfw_n_invalid=INT)
TRAIN_PAIRS = _table(prompt=STR, completion=STR)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` itself, or a ``ValueError`` naming the missing columns. Starts no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}; present: {df.columns}")
    return df


def ensure_column(df: DataFrame, name: str, kind: DataType | str = "string") -> DataFrame:
    """``df`` with a null column ``name`` unless it already has one."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def one_of(value: str, allowed: Iterable[str], what: str) -> str:
    allowed = tuple(allowed)
    if value not in allowed:
        raise ValueError(f"Unknown {what}: {value!r}; expected one of {allowed}")
    return value


def check_domain(domain: str) -> str:
    return one_of(domain, ("math", "science"), "domain")
