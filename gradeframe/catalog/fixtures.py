"""Question, attempt and pair tables derived from the driver tables.

Each is a dictionary of column name to SQL expression that reads the same in Spark and in the
checking engine. ``chr(92)`` is a backslash and ``chr(10)`` a line feed.
"""

from pyspark.sql import DataFrame, SparkSession

BOX = "concat(chr(92), 'boxed{')"

QUESTIONS = {
    "qid": "o_orderkey",
    "question": "concat('Q', o_orderkey)",
    "model": "o_orderpriority",
    "source": "CASE o_orderkey % 3 WHEN 0 THEN 'GSM8K' WHEN 1 THEN 'MATH500' ELSE 'AIME' END",
    "answer": (
        "CASE o_orderkey % 3 WHEN 0 THEN concat('step one #### 1,00', o_orderkey % 5)"
        " WHEN 1 THEN concat(chr(92), 'left( ', o_orderkey % 5, ' , 1 ', chr(92), 'right)')"
        " ELSE concat('', o_orderkey % 5) END"
    ),
    "decision": (
        "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0"
        " ELSE (CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE NULL END) END"
    ),
    "cust": "o_custkey",
    "year": "year(o_orderdate)",
    "n_wanted": "CAST(o_custkey % 6 AS INT)",
}


def _value(key: str, seed: str) -> str:
    return (
        f"CASE {key} % 3 WHEN 0 THEN concat('100', {seed} % 5)"
        f" WHEN 1 THEN concat('(', {seed} % 5, ' , 1)') ELSE concat('', {seed} % 5) END"
    )


def math_text(key: str, seed: str, shape: str) -> str:
    """A model answer: none, behind a reasoning tag, after another box, or nested."""
    x = _value(key, seed)
    return (
        f"CASE ({shape}) % 4 WHEN 0 THEN 'no final answer'"
        f" WHEN 1 THEN concat('<think>', {BOX}, '9}}</think> so ', {BOX}, ' ', {x}, ' }}')"
        f" WHEN 2 THEN concat({BOX}, '7}} then ', {BOX}, {x}, '}}')"
        f" ELSE concat('nested ', {BOX}, chr(92), 'text{{', {x}, '}}}}') END"
    )


def mcq_text(seed: str, shape: str) -> str:
    """A model's choice among A, B and C: none, boxed, leading, or behind a reasoning tag."""
    x = f"chr(CAST(65 + ({seed}) % 3 AS INT))"
    return (
        f"CASE ({shape}) % 4 WHEN 0 THEN 'none'"
        f" WHEN 1 THEN concat('I say ', {BOX}, {x}, '}}')"
        f" WHEN 2 THEN concat({x}, ') because')"
        f" ELSE concat('<think>D</think>(', {x}, ')') END"
    )


ROLLOUT = (
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O'"
    " THEN concat('maybe DELEGATE <decision>', chr(10), 'SELF_SOLVE', chr(10), '</decision>')"
    " WHEN l_returnflag = 'R' THEN '<decision>self_solve</decision>'"
    " WHEN l_returnflag = 'A' AND l_linestatus = 'O'"
    " THEN '<decision>SELF_SOLVE</decision> wait <decision>DELEGATE</decision>'"
    " WHEN l_returnflag = 'A' THEN 'I would delegate.'"
    " WHEN l_linestatus = 'O' THEN 'SELF_SOLVED' ELSE 'unsure' END"
)

ATTEMPTS = {
    "qid": "l_orderkey",
    "attempt": "CAST(l_linenumber - 1 AS INT)",
    "elapsed": "l_quantity",
    "phase": "CASE l_linestatus WHEN 'O' THEN 'post' ELSE 'pre' END",
    "generation": math_text("l_orderkey", "l_partkey", "l_suppkey"),
    "rollout": ROLLOUT,
    "correct_label": "chr(CAST(65 + l_orderkey % 3 AS INT))",
    "mcq_generation": mcq_text("l_partkey", "l_suppkey"),
}

# One attempt of a question that keeps all its attempts in one row; ``attempt`` is its number.
ARRAY_GENERATION = math_text("qid", "(cust + attempt * 7)", "cust + attempt")
ARRAY_MCQ_GENERATION = mcq_text("cust + attempt * 5", "qid + attempt")
ARRAY_LABEL = "chr(CAST(65 + (qid + attempt) % 3 AS INT))"
NUMBERS = "slice(array(0, 1, 2, 3, 4), 1, n_wanted)"

MCQ = {
    "qid": "p_partkey",
    "question": "p_name",
    "category": "p_type",
    "answer_index": "CAST(p_partkey % 4 AS INT)",
    "options": "concat('[\"', p_brand, '\",\"', p_type, '\",\"', p_name, '\",\"size ', p_size, '\"]')",
}

PAIRS = {
    "row_id": "p_partkey",
    "question": "p_name",
    "label_0_analysis": "concat('cannot ', p_partkey)",
    "label_1_analysis": "concat('can ', p_partkey)",
}

GRADED = {
    "qid": "p_partkey",
    "question": "CASE WHEN p_partkey % 10 = 0 THEN concat(p_name, ' x') ELSE p_name END",
    "choices": "concat('(A) ', p_brand, chr(10), '(B) ', p_type)",
    "is_correct": "CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _derived(base: str, columns: dict[str, str]):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, base).selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))

    return build


def _cte(base: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {base}"


questions = _derived("orders", QUESTIONS)
attempts = _derived("lineitem", ATTEMPTS)
mcq = _derived("part", MCQ)
pairs = _derived("part", PAIRS)
graded = _derived("part", GRADED)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with 0 to 5 attempts each, kept as arrays in the row."""
    return questions(spark, folder).selectExpr(
        "*",
        f"transform({NUMBERS}, attempt -> {ARRAY_GENERATION}) AS generation",
        f"transform({NUMBERS}, attempt -> named_struct('correct_label', {ARRAY_LABEL},"
        f" 'generation', {ARRAY_MCQ_GENERATION})) AS attempts",
    )


CTES = {
    "fx_questions": _cte("orders", QUESTIONS),
    "fx_attempts": _cte("lineitem", ATTEMPTS),
    "fx_mcq": _cte("part", MCQ),
    "fx_pairs": _cte("part", PAIRS),
    "fx_graded": _cte("part", GRADED),
    "fx_answers": (
        f"SELECT q.*, attempt, {ARRAY_GENERATION} AS generation, {ARRAY_LABEL} AS correct_label,"
        f" {ARRAY_MCQ_GENERATION} AS mcq_generation"
        " FROM (SELECT *, unnest(range(0, n_wanted)) AS attempt FROM fx_questions) q"
    ),
}
