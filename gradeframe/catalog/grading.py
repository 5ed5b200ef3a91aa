"""Parsing and grading queries."""

from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx, oracle as o
from gradeframe.catalog.registry import query
from gradeframe.functions import parsing as T
from gradeframe.functions.cells import as_attempts, as_list, first_attempt_correct, ingest_cells
from gradeframe.functions.metrics import rounded
from gradeframe.operators import grading as G

KEY = ["qid"]


@query(o.with_tables(f"SELECT qid, attempt, rollout, {o.decision('rollout')} AS decision FROM fx_attempts", "fx_attempts"))
def parse_decision(spark, sf):
    a = fx.attempts(spark, sf)
    return a.select("qid", "attempt", "rollout", T.decision(F.col("rollout")).alias("decision"))


@query(f"SELECT doc_id, {o.decision('text')} AS decision FROM documents")
def parse_decision_documents(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", T.decision(F.col("text")).alias("decision"))


@query(
    o.with_tables(
        f"SELECT qid, attempt, {o.after_think('generation')} AS tail, {o.boxed('generation')} AS boxed FROM fx_attempts",
        "fx_attempts",
    )
)
def boxed_answer(spark, sf):
    text = F.col("generation")
    return fx.attempts(spark, sf).select(
        "qid", "attempt", T.after_think(text).alias("tail"), T.boxed(text).alias("boxed")
    )


@query(
    o.with_tables(
        f"SELECT qid, attempt, mcq_generation, {o.letter('mcq_generation')} AS letter FROM fx_attempts",
        "fx_attempts",
    )
)
def letter_answer(spark, sf):
    return fx.attempts(spark, sf).select(
        "qid", "attempt", "mcq_generation", T.letter(F.col("mcq_generation")).alias("letter")
    )


@query(f"SELECT doc_id, {o.letter('text')} AS letter FROM documents")
def letter_answer_documents(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", T.letter(F.col("text")).alias("letter"))


@query(o.with_tables(f"SELECT qid, source, {o.gold()} AS answer FROM fx_questions", "fx_questions"))
def normalise_gold(spark, sf):
    return G.normalise_gold(fx.questions(spark, sf).select("qid", "source", "answer"))


_LONG = f"""
SELECT q.qid, max(coalesce({o.math_correct('a.generation', o.gold('q.answer', 'q.source'))}, 0)) AS is_correct,
  CAST(count(a.qid) AS BIGINT) AS n_attempts,
  CAST(sum({o.math_correct('a.generation', o.gold('q.answer', 'q.source'))}) AS BIGINT) AS n_correct
FROM fx_questions q LEFT JOIN fx_attempts a ON a.qid = q.qid GROUP BY q.qid
"""
_GRADED = _LONG.replace("SELECT q.qid,", "SELECT q.qid, any_value(q.source) AS source, any_value(q.model) AS model,")


@query(o.with_tables(f"SELECT qid, is_correct FROM ({_LONG})", "fx_questions", "fx_attempts"))
def grade_math_long(spark, sf):
    return G.grade_math_long(fx.questions(spark, sf), fx.attempts(spark, sf), KEY)


@query(o.with_tables(_LONG, "fx_questions", "fx_attempts"))
def grade_math_long_counts(spark, sf):
    return G.grade_math_long(fx.questions(spark, sf), fx.attempts(spark, sf), KEY, counts=True)


@query(
    o.with_tables(
        f"""SELECT phase, qid, CAST(count(*) AS BIGINT) AS n_attempts, CAST(sum(hit) AS BIGINT) AS n_correct,
        max(hit) AS is_correct FROM (
          SELECT a.phase, a.qid, {o.math_correct('a.generation', o.gold('q.answer', 'q.source'))} AS hit
          FROM fx_attempts a JOIN fx_questions q ON a.qid = q.qid) GROUP BY phase, qid""",
        "fx_questions",
        "fx_attempts",
    )
)
def grade_scored_attempts(spark, sf):
    """Labels per question and phase, each phase standing for a model's run."""
    scored = G.score_attempts(fx.questions(spark, sf), fx.attempts(spark, sf), KEY, ["phase"])
    return G.grade_scores(scored, ["phase", "qid"])


_ARRAY = f"""
SELECT q.qid, any_value(q.source) AS source, any_value(q.model) AS model,
  CAST(count(a.qid) AS INT) AS n_attempts,
  CAST(coalesce(sum({o.math_correct('a.generation', o.gold('q.answer', 'q.source'))}), 0) AS INT) AS n_correct,
  CAST(coalesce(max({o.math_correct('a.generation', o.gold('q.answer', 'q.source'))}), 0) AS INT) AS is_correct
FROM fx_questions q LEFT JOIN fx_answers a ON a.qid = q.qid GROUP BY q.qid
"""
_ARRAY_MCQ = f"""
SELECT q.qid, any_value(q.source) AS source, CAST(count(a.qid) AS INT) AS n_attempts,
  CAST(coalesce(sum({o.mcq_correct('a.mcq_generation', 'a.correct_label')}), 0) AS INT) AS n_correct
FROM fx_questions q LEFT JOIN fx_answers a ON a.qid = q.qid GROUP BY q.qid
"""


@query(o.with_tables(f"SELECT qid, n_attempts, n_correct, is_correct FROM ({_ARRAY})", "fx_answers"))
def grade_math_array(spark, sf):
    graded = G.grade(fx.answers(spark, sf), "generation", "math", keep_scores=True)
    return G.with_attempt_counts(graded).select("qid", "n_attempts", "n_correct", "is_correct")


@query(
    o.with_tables(
        f"SELECT qid, n_attempts, n_correct, {o.majority('n_correct', 'n_attempts')} AS is_correct FROM ({_ARRAY_MCQ})",
        "fx_answers",
    )
)
def grade_mcq_array(spark, sf):
    graded = G.grade(fx.answers(spark, sf), "attempts", "science", keep_scores=True)
    return G.with_attempt_counts(graded).select("qid", "n_attempts", "n_correct", "is_correct")


_VOTES = f"""
SELECT qid, CAST(count(*) AS BIGINT) AS n_attempts,
  CAST(sum({o.mcq_correct('mcq_generation', 'correct_label')}) AS BIGINT) AS n_correct
FROM fx_attempts GROUP BY qid
"""


@query(
    o.with_tables(
        f"SELECT *, {o.majority('n_correct', 'n_attempts')} AS is_correct FROM ({_VOTES})", "fx_attempts"
    )
)
def grade_mcq_long(spark, sf):
    return G.grade_mcq_long(fx.attempts(spark, sf), KEY, "mcq_generation")


@query(
    o.with_tables(
        f"""SELECT a.qid, a.attempt, a.generation,
        {o.math_correct('a.generation', o.gold('q.answer', 'q.source'))} AS is_correct
        FROM fx_answers a JOIN fx_questions q ON a.qid = q.qid""",
        "fx_answers",
    )
)
def grade_math_single(spark, sf):
    each = G.explode_attempts(fx.answers(spark, sf).drop("attempts"), "generation")
    single = G.grade(each.filter("attempt IS NOT NULL"), "generation", "math", "single")
    return single.select("qid", F.col("attempt").cast("bigint"), "generation", "is_correct")


@query(
    o.with_tables(
        f"""SELECT qid, attempt, {o.mcq_correct('mcq_generation', 'correct_label')} AS is_correct
        FROM fx_answers""",
        "fx_answers",
    )
)
def grade_mcq_single(spark, sf):
    each = G.explode_attempts(fx.answers(spark, sf).drop("generation"), "attempts")
    single = G.grade(each.filter("attempt IS NOT NULL"), "attempts", "science", "single")
    return single.select("qid", F.col("attempt").cast("bigint"), "is_correct")


@query(
    o.with_tables(
        """SELECT qid, n_wanted AS n_attempts, CASE WHEN n_wanted = 0 THEN NULL ELSE attempt END AS attempt,
        generation FROM fx_answers UNION ALL
        SELECT qid, n_wanted, NULL, NULL FROM fx_questions WHERE n_wanted = 0""",
        "fx_answers",
    )
)
def explode_attempts(spark, sf):
    each = G.explode_attempts(fx.answers(spark, sf), "generation")
    return each.select("qid", F.col("n_wanted").alias("n_attempts"), F.col("attempt").cast("bigint"), "generation")


@query(
    o.with_tables(
        """SELECT qid, CAST(count(*) AS INT) AS n, string_agg(generation, '|' ORDER BY attempt) AS texts
        FROM fx_answers GROUP BY qid""",
        "fx_answers",
    )
)
def collect_attempts(spark, sf):
    each = G.explode_attempts(fx.answers(spark, sf), "generation").filter("attempt IS NOT NULL")
    rows = G.collect_attempts(each, KEY, ["generation"])
    return rows.select("qid", F.size("attempts").alias("n"), F.array_join("attempts", "|").alias("texts"))


@query(
    o.with_tables(
        f"""SELECT attempt, CAST(sum(hit) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n,
        round(avg(hit), 6) AS accuracy FROM (
          SELECT a.attempt, {o.math_correct('a.generation', o.gold('q.answer', 'q.source'))} AS hit
          FROM fx_answers a JOIN fx_questions q ON a.qid = q.qid) GROUP BY attempt""",
        "fx_answers",
    )
)
def attempt_report(spark, sf):
    scored = G.attempt_scores(fx.answers(spark, sf), "generation", "math")
    return rounded(G.attempt_report(scored).withColumn("attempt", F.col("attempt").cast("bigint")))


@query(
    o.with_tables(
        f"""SELECT attempt, CAST(sum(hit) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n,
        round(avg(hit), 6) AS accuracy FROM (
          SELECT a.attempt, {o.math_correct('a.generation', o.gold('q.answer', 'q.source'))} AS hit
          FROM fx_attempts a JOIN fx_questions q ON a.qid = q.qid) GROUP BY attempt""",
        "fx_questions",
        "fx_attempts",
    )
)
def attempt_report_long(spark, sf):
    return rounded(
        G.attempt_report_long(fx.questions(spark, sf), fx.attempts(spark, sf), KEY)
    )


_BOUNDS = """SELECT CAST(min(n_attempts) AS BIGINT) AS min_attempts,
  CAST(max(n_attempts) AS BIGINT) AS max_attempts, CAST(sum(n_attempts) AS BIGINT) AS n_scores,
  round(coalesce(sum(n_correct) / CAST(nullif(sum(n_attempts), 0) AS DOUBLE), 0), 6) AS average FROM"""


@query(o.with_tables(f"{_BOUNDS} ({_ARRAY})", "fx_answers"))
def attempt_bounds(spark, sf):
    scored = G.attempt_scores(fx.answers(spark, sf), "generation", "math")
    return rounded(G.attempt_bounds(G.with_attempt_counts(scored)))


@query(o.with_tables(f"{_BOUNDS} ({_LONG})", "fx_questions", "fx_attempts"))
def attempt_bounds_long(spark, sf):
    graded = G.grade_math_long(fx.questions(spark, sf), fx.attempts(spark, sf), KEY, counts=True)
    return rounded(G.attempt_bounds(graded))


@query(
    o.with_tables(
        f"""SELECT attempt, CAST(sum(hit) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n,
        round(avg(hit), 6) AS accuracy FROM (
          SELECT attempt, {o.mcq_correct('mcq_generation', 'correct_label')} AS hit FROM fx_answers)
        GROUP BY attempt""",
        "fx_answers",
    )
)
def attempt_report_mcq(spark, sf):
    scored = G.attempt_scores(fx.answers(spark, sf), "attempts", "science")
    return rounded(G.attempt_report(scored).withColumn("attempt", F.col("attempt").cast("bigint")))


@query(o.with_tables(f"{_BOUNDS} ({_ARRAY_MCQ})", "fx_answers"))
def attempt_bounds_mcq(spark, sf):
    scored = G.attempt_scores(fx.answers(spark, sf), "attempts", "science")
    return rounded(G.attempt_bounds(G.with_attempt_counts(scored)))


_BY_SOURCE = """SELECT source, CAST(sum(is_correct) AS BIGINT) AS n_correct,
  CAST(count(*) AS BIGINT) AS n, round(avg(is_correct), 6) AS accuracy FROM"""


@query(o.with_tables(f"{_BY_SOURCE} ({_ARRAY}) GROUP BY source", "fx_answers"))
def source_report(spark, sf):
    return rounded(G.source_report(G.grade(fx.answers(spark, sf), "generation", "math")))


@query(
    o.with_tables(
        f"""{_BY_SOURCE} (SELECT source, {o.majority('n_correct', 'n_attempts')} AS is_correct
        FROM ({_ARRAY_MCQ})) GROUP BY source""",
        "fx_answers",
    )
)
def source_report_mcq(spark, sf):
    return rounded(G.source_report(G.grade(fx.answers(spark, sf), "attempts", "science")))


@query(
    o.with_tables(
        f"""SELECT model, CAST(sum(is_correct) AS BIGINT) AS n_correct, CAST(count(*) AS BIGINT) AS n,
        round(avg(is_correct), 6) AS accuracy FROM ({_ARRAY}) GROUP BY model""",
        "fx_answers",
    )
)
def solve_accuracy_by_model(spark, sf):
    return rounded(G.solve_accuracy(G.grade(fx.answers(spark, sf), "generation", "math"), ["model"]))


def _cells(spark, sf):
    """The attempts of a question written as one JSON cell, as a foreign CSV holds them."""
    return fx.answers(spark, sf).withColumn("cell", F.to_json("generation"))


@query(
    o.with_tables(
        """SELECT q.qid, 'json' AS parse_status, CAST(count(a.qid) AS INT) AS n,
        coalesce(string_agg(a.generation, '|' ORDER BY a.attempt), '') AS texts
        FROM fx_questions q LEFT JOIN fx_answers a ON a.qid = q.qid GROUP BY q.qid""",
        "fx_answers",
    )
)
def ingest_cells_math(spark, sf):
    read = ingest_cells(_cells(spark, sf), "cell").withColumn("texts", as_list(F.col("value")))
    return read.select(
        "qid", "parse_status", F.size("texts").alias("n"), F.array_join("texts", "|").alias("texts")
    )


@query(
    o.with_tables(
        """SELECT q.qid, 'json' AS parse_status, CAST(count(a.qid) AS INT) AS n,
        coalesce(string_agg(a.correct_label || ':' || a.mcq_generation, '|' ORDER BY a.attempt), '') AS votes
        FROM fx_questions q LEFT JOIN fx_answers a ON a.qid = q.qid GROUP BY q.qid""",
        "fx_answers",
    )
)
def ingest_cells_mcq(spark, sf):
    cells = fx.answers(spark, sf).withColumn("cell", F.to_json("attempts"))
    read = ingest_cells(cells, "cell").withColumn("votes", as_attempts(F.col("value")))
    votes = F.transform("votes", lambda v: F.concat(v["correct_label"], F.lit(":"), v["generation"]))
    return read.select(
        "qid", "parse_status", F.size("votes").alias("n"), F.array_join(votes, "|").alias("votes")
    )


@query(
    o.with_tables(
        """SELECT q.qid, 'quoted' AS parse_status, CAST(count(a.qid) AS INT) AS n,
        coalesce(string_agg(a.correct_label || ':' || a.mcq_generation, '|' ORDER BY a.attempt), '') AS votes
        FROM fx_questions q LEFT JOIN fx_answers a ON a.qid = q.qid GROUP BY q.qid HAVING count(a.qid) > 0""",
        "fx_answers",
    )
)
def ingest_cells_quoted(spark, sf):
    """Cells written with single quotes, as a Python program prints a list."""
    quoted = F.replace(F.to_json("attempts"), F.lit('"'), F.lit("'"))
    cells = fx.answers(spark, sf).withColumn("cell", quoted).filter(F.size("attempts") > 0)
    read = ingest_cells(cells, "cell").withColumn("votes", as_attempts(F.col("value")))
    votes = F.transform("votes", lambda v: F.concat(v["correct_label"], F.lit(":"), v["generation"]))
    return read.select(
        "qid", "parse_status", F.size("votes").alias("n"), F.array_join(votes, "|").alias("votes")
    )


@query(
    o.with_tables(
        """SELECT q.qid, 'fallback' AS parse_status, CAST(count(a.qid) AS INT) AS n,
        coalesce(string_agg(a.correct_label || ':' || a.mcq_generation, '|' ORDER BY a.attempt), '') AS votes
        FROM fx_questions q LEFT JOIN fx_answers a ON a.qid = q.qid GROUP BY q.qid HAVING count(a.qid) > 0""",
        "fx_answers",
    )
)
def ingest_cells_fallback(spark, sf):
    """Cells that end in a comma, which is legal in Python only."""
    quoted = F.replace(F.to_json("attempts"), F.lit('"'), F.lit("'"))
    open_list = F.regexp_replace(quoted, r"\]$", ",]")
    cells = fx.answers(spark, sf).withColumn("cell", open_list).filter(F.size("attempts") > 0)
    read = ingest_cells(cells, "cell", fallback="native").withColumn("votes", as_attempts(F.col("value")))
    votes = F.transform("votes", lambda v: F.concat(v["correct_label"], F.lit(":"), v["generation"]))
    return read.select(
        "qid", "parse_status", F.size("votes").alias("n"), F.array_join(votes, "|").alias("votes")
    )


@query(
    o.with_tables(
        """SELECT qid, 'fallback' AS parse_status, 'None of ' || question || ' is True, it''s "null"' AS generation,
        qid % 2 = 0 AS ok, CAST(NULL AS VARCHAR) AS rest, -qid AS n FROM fx_questions""",
        "fx_questions",
    )
)
def ingest_cells_words(spark, sf):
    """Cells in mixed notation, whose strings hold the words of both; read without Python."""
    cell = F.format_string(
        "{'generation': 'None of %s is True, it\\'s \"null\"', \"ok\": %s, 'rest': None, 'n': -%d,}",
        F.col("question").cast("string"), F.when(F.col("qid") % 2 == 0, "true").otherwise("False"), F.col("qid"),
    )
    read = ingest_cells(fx.questions(spark, sf).withColumn("cell", cell), "cell", fallback="native")

    def field(name, kind):
        return F.try_variant_get("value", f"$.{name}", kind).alias(name)

    return read.select(
        "qid", "parse_status", field("generation", "string"), field("ok", "boolean"), field("rest", "string"),
        field("n", "bigint"),
    )


@query(
    o.with_tables(
        f"SELECT qid, 'json' AS parse_status, is_correct FROM ({_ARRAY})", "fx_answers"
    )
)
def grade_cells_math(spark, sf):
    return G.grade_cells(_cells(spark, sf), "cell", "math").select("qid", "parse_status", "is_correct")


@query(
    o.with_tables(
        f"""SELECT q.qid, coalesce({o.mcq_correct('a.mcq_generation', 'a.correct_label')}, 0) AS is_correct
        FROM fx_questions q LEFT JOIN fx_answers a ON a.qid = q.qid AND a.attempt = 0""",
        "fx_answers",
    )
)
def grade_cells_mcq_single(spark, sf):
    cells = fx.answers(spark, sf).withColumn("cell", F.to_json("attempts"))
    read = ingest_cells(cells, "cell")
    return read.select("qid", first_attempt_correct(F.col("value")).alias("is_correct"))


@query(
    o.with_tables(
        f"""SELECT qid, 'json' AS parse_status, {o.majority('n_correct', 'n_attempts')} AS is_correct
        FROM ({_ARRAY_MCQ})""",
        "fx_answers",
    )
)
def grade_cells_mcq(spark, sf):
    cells = fx.answers(spark, sf).withColumn("cell", F.to_json("attempts"))
    return G.grade_cells(cells, "cell", "science").select("qid", "parse_status", "is_correct")
