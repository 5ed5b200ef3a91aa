"""Sampling, split, option and question-set queries."""

from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx, oracle as o
from gradeframe.catalog.registry import query
from gradeframe.functions import options as O
from gradeframe.operators import sampling as S
from gradeframe.plans import question_sets as Q

CATEGORIES = ("ECONOMY", "MEDIUM", "PROMO", "LARGE")
CATEGORY_LIST = ", ".join(o.text(c) for c in CATEGORIES)


def _order(key: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"


def _quotas(rows: str, column: str, size: int) -> str:
    return f"""
SELECT {column}, CAST(c * {size} // total AS BIGINT)
    + CASE WHEN row_number() OVER (ORDER BY c * {size} % total DESC, {column})
        <= {size} - sum(CAST(c * {size} // total AS BIGINT)) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT {column}, count(*) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS total
  FROM ({rows}) GROUP BY {column})"""


def _stratified(rows: str, columns: str, key: str, column: str, size: int) -> str:
    return f"""
SELECT {columns}, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY {_order(key)}) AS rn FROM ({rows}))
JOIN ({_quotas(rows, column, size)}) USING ({column})"""


@query(
    f"""SELECT doc_id, source FROM (
      SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_order('doc_id')}) AS rn
      FROM documents) WHERE rn <= 3"""
)
def sample_per_source(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    return S.sample_n(docs, 3, ["doc_id"], ["source"])


@query(
    f"""SELECT doc_id, lang FROM (
      SELECT doc_id, lang, row_number() OVER (ORDER BY {_order('doc_id', 7)}) AS rn
      FROM documents) WHERE rn <= 100"""
)
def sample_whole_table(spark, sf):
    return S.sample_n(fx.table(spark, sf, "documents").select("doc_id", "lang"), 100, ["doc_id"], seed=7)


@query(
    f"""SELECT item_id, CASE WHEN rn <= 20 THEN 'train' ELSE 'test' END AS split FROM (
      SELECT item_id, row_number() OVER (ORDER BY {_order('item_id')}) AS rn FROM benchmark)
    WHERE rn <= 30"""
)
def split_counts(spark, sf):
    return S.split_counts(fx.table(spark, sf, "benchmark").select("item_id"), 20, 10, ["item_id"])


@query(
    f"""SELECT doc_id, lang, CASE WHEN rn <= 20 THEN 'train' ELSE 'test' END AS split FROM (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_order('doc_id')}) AS rn FROM documents)
    WHERE rn <= 30"""
)
def split_counts_by_lang(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return S.split_counts(docs, 20, 10, ["doc_id"], ["lang"])


@query(o.with_tables(_stratified("SELECT * FROM fx_mcq", "qid, category", "qid", "category", 70), "fx_mcq"))
def stratified_split(spark, sf):
    return S.stratified_split(fx.mcq(spark, sf).select("qid", "category"), ["category"], 70, ["qid"])


@query(
    f"SELECT doc_id, {_order('doc_id')} AS position FROM documents"
)
def shuffle_rows(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return S.shuffle_rows(docs, ["doc_id"]).withColumn("position", S.hash_order(["doc_id"], 42))


@query(
    o.with_tables(
        f"SELECT qid, question, category, answer_index FROM fx_mcq WHERE category IN ({CATEGORY_LIST})", "fx_mcq"
    )
)
def filter_categories(spark, sf):
    kept = S.filter_categories(fx.mcq(spark, sf), CATEGORIES)
    complete = S.drop_incomplete(kept, ["question", "answer_index"])
    return complete.drop("cot_content", "options")


@query(o.with_tables("SELECT qid, question, answer, source FROM fx_questions WHERE year <= 1998", "fx_questions"))
def year_cut(spark, sf):
    return fx.questions(spark, sf).filter(F.col("year") <= 1998).select("qid", "question", "answer", "source")


@query(
    """SELECT doc_id AS id, text, source, 'train' AS split FROM documents
    UNION ALL SELECT item_id, text, 'BENCHMARK', 'test' FROM benchmark"""
)
def union_sources(spark, sf):
    docs = fx.table(spark, sf, "documents")
    bench = fx.table(spark, sf, "benchmark")
    return S.union_sources(
        [
            docs.select(F.col("doc_id").alias("id"), "text", "source", F.lit("train").alias("split")),
            bench.select(
                F.lit("test").alias("split"), "text", F.col("item_id").alias("id"), F.lit("BENCHMARK").alias("source")
            ),
        ]
    )


@query(
    o.with_tables(
        f"""
SELECT qid, question, answer, source, split FROM (
  SELECT *, 'train' AS split, row_number() OVER (ORDER BY {_order('qid')}) AS rn FROM fx_questions
  WHERE source = 'GSM8K' AND year <= 1999) WHERE rn <= 200
UNION ALL SELECT qid, question, answer, source, split FROM (
  SELECT *, 'test' AS split, row_number() OVER (ORDER BY {_order('qid')}) AS rn FROM fx_questions
  WHERE source = 'GSM8K' AND year > 1999) WHERE rn <= 60
UNION ALL SELECT qid, question, answer, source, CASE WHEN rn <= 80 THEN 'train' ELSE 'test' END FROM (
  SELECT *, row_number() OVER (ORDER BY {_order('qid')}) AS rn FROM fx_questions
  WHERE source = 'MATH500') WHERE rn <= 100
UNION ALL SELECT qid, question, answer, source, 'train' FROM fx_questions WHERE source = 'AIME' AND year <= 1997
UNION ALL SELECT qid, question, answer, source, 'test' FROM fx_questions
  WHERE source = 'AIME' AND year > 1997""",
        "fx_questions",
    )
)
def build_math_set(spark, sf):
    q = fx.questions(spark, sf)
    gsm, aime = q.filter("source = 'GSM8K'"), q.filter("source = 'AIME'")
    return Q.build_math_set(
        gsm.filter("year <= 1999"),
        gsm.filter("year > 1999"),
        q.filter("source = 'MATH500'"),
        aime,
        aime.filter("year > 1997"),
        key=["qid"],
        gsm8k_sizes=(200, 60),
        math500_sizes=(80, 20),
        last_year=1997,
    )


_KEPT = f"SELECT * FROM fx_mcq WHERE category IN ({CATEGORY_LIST})"


@query(
    o.with_tables(
        _stratified(_KEPT, "qid, question, category, answer_index, options", "qid", "category", 100), "fx_mcq"
    )
)
def build_mcq_set(spark, sf):
    questions = fx.mcq(spark, sf).withColumn("options", O.parse_options(F.col("options")))
    return Q.build_mcq_set(questions, 100, ["qid"], CATEGORIES)


_OPTIONS = """from_json(options, '["VARCHAR"]')"""
_FORMATTED = (
    f"array_to_string(list_transform({_OPTIONS}, lambda t, i: '(' || chr(CAST(64 + i AS INT)) || ') ' || t), chr(10))"
)


@query(
    o.with_tables(
        f"SELECT qid, CAST(len({_OPTIONS}) AS INT) AS n, array_to_string({_OPTIONS}, '|') AS joined FROM fx_mcq",
        "fx_mcq",
    )
)
def parse_options(spark, sf):
    parsed = fx.mcq(spark, sf).withColumn("options", O.parse_options(F.col("options")))
    return parsed.select("qid", F.size("options").alias("n"), F.array_join("options", "|").alias("joined"))


@query(o.with_tables(f"SELECT qid, {_FORMATTED} AS choices FROM fx_mcq", "fx_mcq"))
def format_options(spark, sf):
    return fx.mcq(spark, sf).select(
        "qid", O.format_options(O.parse_options(F.col("options"))).alias("choices")
    )


@query(
    o.with_tables(
        f"SELECT qid, CAST(to_json(list_transform({_OPTIONS}, lambda t: upper(t))) AS VARCHAR) AS options FROM fx_mcq",
        "fx_mcq",
    )
)
def encode_options(spark, sf):
    parsed = O.parse_options(F.col("options"))
    return fx.mcq(spark, sf).select(
        "qid", O.encode_options(F.transform(parsed, F.upper)).alias("options")
    )


SHUFFLES = f"""
SELECT qid, attempt, list_transform(list_sort(list_transform(range(0, 4), lambda i:
    {{'h': md5(concat_ws('|', '42', CAST(qid AS VARCHAR), CAST(attempt AS VARCHAR), CAST(i AS VARCHAR))), 'i': i}})),
    lambda s: s.i) AS ord, answer_index, {_OPTIONS} AS opts, question
FROM fx_mcq, (SELECT unnest(range(0, 3)) AS attempt)"""


@query(
    o.with_tables(
        f"""SELECT qid, attempt, array_to_string(ord, ',') AS shuffled_order,
        chr(CAST(64 + list_position(ord, answer_index) AS INT)) AS correct_label,
        array_to_string(list_transform(ord, lambda i: opts[i + 1]), '|') AS options
        FROM ({SHUFFLES})""",
        "fx_mcq",
    )
)
def shuffle_options(spark, sf):
    from gradeframe.operators.generation import expand_attempts

    parsed = fx.mcq(spark, sf).withColumn("options", O.parse_options(F.col("options")))
    each = expand_attempts(parsed, 3).withColumn(
        "order", O.shuffled_order(F.size("options"), F.col("qid"), F.col("attempt"), 42)
    )
    return each.select(
        "qid",
        F.col("attempt").cast("bigint"),
        F.array_join("order", ",").alias("shuffled_order"),
        O.remapped_letter(F.col("order"), F.col("answer_index")).alias("correct_label"),
        F.array_join(O.reorder(F.col("options"), F.col("order")), "|").alias("options"),
    )
