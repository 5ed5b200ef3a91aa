"""Prompt, rationale-selection and training-table queries."""

from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx, oracle as o
from gradeframe.catalog.registry import query
from gradeframe.catalog.sets import _FORMATTED
from gradeframe.functions import options as O, prompts as P
from gradeframe.functions.metrics import rounded
from gradeframe.functions.parsing import label_word
from gradeframe.operators import generation as N, joins as J
from gradeframe.plans import generation as RUN, training as T

_QUERY_MCQ = f"'Question: ' || question || chr(10) || 'Choices:' || chr(10) || {_FORMATTED}"
_QUERY_MATH = "'Question: ' || question"
_QUERY_CHOICES = "'Question: ' || question || chr(10) || 'Choices:' || chr(10) || choices"
_WORD = "CASE WHEN is_correct = 1 THEN 'SELF_SOLVE' ELSE 'DELEGATE' END"
MARKUP = {"user_prefix": "<user>\n", "user_suffix": "\n<assistant>\n", "eos": "<end>"}


def _mcq(spark, sf):
    return fx.mcq(spark, sf).withColumn("options", O.parse_options(F.col("options")))


@query(
    o.with_tables(
        f"SELECT qid, {_QUERY_MCQ} AS science, {_QUERY_MATH} AS math, {_QUERY_MCQ} AS by_presence FROM fx_mcq",
        "fx_mcq",
    )
)
def query_text(spark, sf):
    m = _mcq(spark, sf)
    return m.select(
        "qid",
        RUN.domain_query(m, "science").alias("science"),
        RUN.domain_query(m, "math").alias("math"),
        P.query_text_by_presence(F.col("question"), F.col("options")).alias("by_presence"),
    )


@query(o.with_tables(f"SELECT qid, {_QUERY_CHOICES} AS query FROM fx_graded", "fx_graded"))
def query_text_from_choices(spark, sf):
    g = fx.graded(spark, sf)
    return g.select("qid", RUN.domain_query(g, "science").alias("query"))


@query(o.with_tables(f"SELECT qid, {_FORMATTED} AS choices FROM fx_mcq", "fx_mcq"))
def with_choices(spark, sf):
    return T.with_choices(_mcq(spark, sf)).select("qid", "choices")


@query(
    o.with_tables(
        f"""SELECT qid, {o.fill(P.ANSWER_MATH, question='question')} AS math,
        {o.fill(P.ANSWER_SCIENCE, question='question', choices=_FORMATTED)} AS science FROM fx_mcq""",
        "fx_mcq",
    )
)
def answer_prompt(spark, sf):
    return _mcq(spark, sf).select(
        "qid",
        P.answer_prompt("math", F.col("question")).alias("math"),
        P.answer_prompt("science", F.col("question"), F.col("options")).alias("science"),
    )


@query(
    o.with_tables(
        f"""SELECT qid, {o.fill(P.DECIDE_WITH_ANALYSIS, query=_QUERY_MCQ)} AS with_analysis,
        {o.fill(P.DECIDE_ONLY, query=_QUERY_MATH)} AS only_decision FROM fx_mcq""",
        "fx_mcq",
    )
)
def decision_prompt(spark, sf):
    m = _mcq(spark, sf)
    return m.select(
        "qid",
        P.decision_prompt(RUN.domain_query(m, "science")).alias("with_analysis"),
        P.decision_prompt(RUN.domain_query(m, "math"), True).alias("only_decision"),
    )


_LABEL_WORD = "CASE label WHEN 1 THEN 'SELF_SOLVE' ELSE 'DELEGATE' END"


@query(
    o.with_tables(
        f"""SELECT qid, label, {o.fill(P.RATIONALE_TEACHER, query=_QUERY_MATH, decision=_LABEL_WORD)} AS teacher,
        {o.fill(P.RATIONALE_SELF, query=_QUERY_MATH, decision=_WORD)} AS self
        FROM fx_graded, (SELECT unnest([0, 1]) AS label)""",
        "fx_graded",
    )
)
def rationale_prompt(spark, sf):
    both = N.expand_labels(fx.graded(spark, sf))
    text = P.query_text_by_presence(F.col("question"))
    return both.select(
        "qid",
        "label",
        P.rationale_prompt(text, label_word(F.col("label")), "teacher").alias("teacher"),
        P.rationale_prompt(text, label_word(F.col("is_correct")), "self").alias("self"),
    )


@query(
    o.with_tables(
        """SELECT qid, 'r' || question || '0' AS label_0_analysis, 'r' || question || '1' AS label_1_analysis
        FROM fx_graded""",
        "fx_graded",
    )
)
def collapse_labels(spark, sf):
    both = N.expand_labels(fx.graded(spark, sf).select("qid", "question"))
    texts = both.withColumn("text", F.concat(F.lit("r"), "question", F.col("label").cast("string")))
    return N.collapse_labels(texts, ["qid"], "text")


_FIRST = """SELECT question, arg_min(label_0_analysis, row_id) AS a0, arg_min(label_1_analysis, row_id) AS a1
FROM fx_pairs GROUP BY question"""
_SELECTED = f"""SELECT g.*, CASE WHEN g.is_correct = 1 THEN p.a1 ELSE p.a0 END AS analysis,
  p.question IS NOT NULL AS has_pair FROM fx_graded g LEFT JOIN ({_FIRST}) p ON g.question = p.question"""


def _selected(spark, sf):
    return J.select_analysis(fx.graded(spark, sf), fx.pairs(spark, sf), spread_by=["qid"])


@query(o.with_tables(_SELECTED, "fx_graded", "fx_pairs"))
def select_analysis(spark, sf):
    return _selected(spark, sf)


@query(
    o.with_tables(
        f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(NOT has_pair) AS BIGINT) AS n_unmatched
        FROM ({_SELECTED})""",
        "fx_graded",
        "fx_pairs",
    )
)
def unmatched_analysis(spark, sf):
    return J.unmatched_report(_selected(spark, sf))


@query(
    o.with_tables(
        """SELECT question, arg_min(row_id, row_id) AS row_id, arg_min(label_0_analysis, row_id) AS label_0_analysis,
        arg_min(label_1_analysis, row_id) AS label_1_analysis FROM fx_pairs GROUP BY question""",
        "fx_pairs",
    )
)
def first_per_question(spark, sf):
    return J.first_per_key(fx.pairs(spark, sf), ["question"], ["row_id"])


def _wrapped(template: str, **columns: str) -> str:
    return (
        f"{o.text(MARKUP['user_prefix'])} || {o.fill(template, **columns)} || {o.text(MARKUP['user_suffix'])}"
    )


def _completion(template: str, **columns: str) -> str:
    return f"{o.fill(template, **columns)} || {o.text(MARKUP['eos'])}"


_SFT = f"""SELECT qid, {_wrapped(P.train_template('math', 'teacher'), question='question')} AS prompt,
  {_completion(P.RESPONSE_ANALYSIS, decision=_WORD, analysis="coalesce(analysis, '')")} AS completion
FROM ({_SELECTED})"""


@query(
    o.with_tables(
        f"""SELECT qid, {_wrapped(P.train_template('science', 'label'), question='question', choices='choices')} AS prompt,
        {_completion(P.RESPONSE_LABEL, decision=_WORD)} AS completion FROM fx_graded""",
        "fx_graded",
    )
)
def sft_render(spark, sf):
    return T.render_pairs(fx.graded(spark, sf), "science", "label", keep=["qid"], **MARKUP)


@query(o.with_tables(_SFT, "fx_graded", "fx_pairs"))
def sft_pairs(spark, sf):
    return T.build_sft(
        fx.graded(spark, sf), fx.pairs(spark, sf), keep=["qid"], spread_by=["qid"], **MARKUP
    )


_WORDS = r"len(regexp_extract_all({}, '\S+'))"


@query(
    o.with_tables(
        f"SELECT * FROM ({_SFT}) WHERE {_WORDS.format('prompt || completion')} <= 53", "fx_graded", "fx_pairs"
    )
)
def sft_pairs_short(spark, sf):
    return T.build_sft(
        fx.graded(spark, sf), fx.pairs(spark, sf), max_tokens=53, keep=["qid"], spread_by=["qid"], **MARKUP
    )


_ROLLOUT_TEMPLATE = P.TRAIN_BODY.format(format=P._ANALYSIS_FORMAT, query="{query}")


@query(
    o.with_tables(
        f"""SELECT qid, question, choices, is_correct,
        {_wrapped(_ROLLOUT_TEMPLATE, query=_QUERY_CHOICES)} AS prompt FROM fx_graded""",
        "fx_graded",
    )
)
def rollout_prompts(spark, sf):
    return T.render_prompts(
        fx.graded(spark, sf), "science", MARKUP["user_prefix"], MARKUP["user_suffix"]
    )


_TURNS = """SELECT conv_id, turn, role || ': ' AS prompt, text AS completion FROM conversations
WHERE role = 'assistant'"""
_TURN_WORDS = _WORDS.format("prompt || completion")


def _turns(spark, sf):
    rows = fx.table(spark, sf, "conversations").filter("role = 'assistant'")
    return rows.select(
        "conv_id", "turn", F.concat("role", F.lit(": ")).alias("prompt"), F.col("text").alias("completion")
    )


@query(f"SELECT * FROM ({_TURNS}) WHERE {_TURN_WORDS} <= 60")
def length_filter(spark, sf):
    return T.fits(_turns(spark, sf), 60)


def char_counter():
    return lambda texts: [len(t) for t in texts]


@query(f"SELECT * FROM ({_TURNS}) WHERE length(prompt || completion) <= 400")
def length_filter_custom(spark, sf):
    """The same filter with a counter of the caller: characters instead of words."""
    return T.fits(_turns(spark, sf), 400, char_counter)


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS n_before, CAST(count_if({_TURN_WORDS} > 60) AS BIGINT) AS n_dropped,
    CAST(count_if({_TURN_WORDS} <= 60) AS BIGINT) AS n_kept FROM ({_TURNS})"""
)
def length_report(spark, sf):
    return T.length_report(_turns(spark, sf), 60)


@query(
    f"""SELECT role, CAST(count(text) AS BIGINT) AS n_texts,
    round(coalesce(avg({_WORDS.format('text')}), 0), 6) AS mean_tokens FROM conversations GROUP BY role"""
)
def token_length_report(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    return rounded(T.token_length_report(turns, "text", by=["role"]))


@query(
    """SELECT CAST(count(text) AS BIGINT) AS n_texts, round(coalesce(avg(length(text)), 0), 6) AS mean_tokens
    FROM documents"""
)
def token_length_custom(spark, sf):
    return rounded(T.token_length_report(fx.table(spark, sf, "documents"), "text", char_counter))
