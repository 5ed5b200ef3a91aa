"""Batch generation with a stub model, resume, incremental and streaming queries."""

from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx, oracle as o, stubs
from gradeframe.catalog.registry import query
from gradeframe.catalog.reports import REWARD_REPORT
from gradeframe.catalog.sets import SHUFFLES, _FORMATTED
from gradeframe.catalog.training import _QUERY_MATH, _WORD, _mcq
from gradeframe.functions import prompts as P
from gradeframe.functions.metrics import rounded
from gradeframe.functions.parsing import is_error
from gradeframe.operators import generation as N, joins as J
from gradeframe.operators.answers import ask_once
from gradeframe.plans import generation as RUN
from gradeframe.session import fresh_path
from gradeframe.sources import snapshots, tables as S
from gradeframe.streaming import incremental as I

_ANSWER = o.fill(P.ANSWER_MATH, question="question")
_ANSWER_MCQ = o.fill(P.ANSWER_SCIENCE, question="question", choices=_FORMATTED)
_DECIDE = o.fill(P.DECIDE_WITH_ANALYSIS, query=_QUERY_MATH)


def _digit(prompt: str, sample: str) -> str:
    return o.pick(f"({prompt}) || '|' || CAST({sample} AS VARCHAR)")


def _number(prompt: str, sample: str) -> str:
    return f"'so ' || chr(92) || 'boxed{{' || CAST({_digit(prompt, sample)} % 5 AS VARCHAR) || '}}'"


def _decided(prompt: str, sample: str) -> str:
    d = _digit(prompt, sample)
    return (
        f"CASE WHEN {d} < 7 THEN '<decision>SELF_SOLVE</decision>'"
        f" WHEN {d} < 14 THEN 'I would delegate.' ELSE 'unsure' END"
    )


_THREE = f"concat_ws('|', {_number(_ANSWER, '0')}, {_number(_ANSWER, '1')}, {_number(_ANSWER, '2')})"


def _hash(prompt: str) -> str:
    return f"md5(({prompt}) || '|0')"


@query(
    o.with_tables(
        f"SELECT qid, {_THREE} AS texts, 3 AS n FROM fx_questions",
        "fx_questions",
    )
)
def generate_stub(spark, sf):
    """Three answers each, the prompts spread over tasks first."""
    run = RUN.answer_questions(fx.questions(spark, sf), stubs.number_model, "math", 3, partitions=8)
    return run.select(
        "qid", F.array_join("generation", "|").alias("texts"), F.size("generation").alias("n")
    )


@query(o.with_tables(f"SELECT qid, {_THREE} AS texts, 3 AS n FROM fx_questions", "fx_questions"))
def generate_balanced(spark, sf):
    """Prompts dealt to tasks by their length."""
    run = RUN.answer_questions(
        fx.questions(spark, sf), stubs.number_model, "math", 3, partitions=8, balance=True
    )
    return run.select("qid", F.array_join("generation", "|").alias("texts"), F.size("generation").alias("n"))


@query(o.with_tables(f"SELECT qid, {_THREE} AS texts FROM fx_questions", "fx_questions"))
def generate_once(spark, sf):
    """Answers kept by prompt; the second run asks for what the first did not."""
    q = fx.questions(spark, sf).select("qid", "question", "decision")
    prompts = q.select("qid", "decision", P.answer_prompt("math", F.col("question")).alias("prompt"))
    store = fresh_path(spark, "answers")
    ask_once(prompts.filter("decision = 1"), "prompt", stubs.number_model, store, "stub", 3)
    run = ask_once(prompts, "prompt", stubs.number_model, store, "stub", 3)
    return run.select("qid", F.array_join("generation", "|").alias("texts"))


@query(
    o.with_tables(
        f"""SELECT qid, CASE WHEN {_digit(_ANSWER, '0')} >= 12 THEN 'Error: 1 texts in the reply, 2 were asked for'
        ELSE {_number(_ANSWER, '0')} END AS first FROM fx_questions""",
        "fx_questions",
    )
)
def generate_short_replies(spark, sf):
    """Prompts whose reply lacks a text get error texts, the others keep their replies."""
    run = RUN.answer_questions(fx.questions(spark, sf), stubs.short_model, "math", 2)
    return run.select("qid", F.get("generation", 0).alias("first"))


@query(
    o.with_tables(
        f"""SELECT qid, CASE WHEN {_digit(_ANSWER, '0')} >= 12 THEN 'Error: refused'
        ELSE {_number(_ANSWER, '0')} END AS generation FROM fx_questions""",
        "fx_questions",
    )
)
def generate_with_errors(spark, sf):
    run = RUN.answer_questions(fx.questions(spark, sf), stubs.failing_model, "math", 1)
    return run.select("qid", F.get("generation", 0).alias("generation"))


@query(
    o.with_tables(
        f"""SELECT qid, {_number(_ANSWER_MCQ, '0')} AS first, {_number(_ANSWER_MCQ, '0')} AS last FROM fx_mcq""",
        "fx_mcq",
    )
)
def generate_per_call(spark, sf):
    """Two calls of one answer each per question, options in their given order."""
    run = RUN.answer_questions(
        _mcq(spark, sf), stubs.number_model, "science", 2, per_call=True
    )
    return run.select("qid", F.get("generation", 0).alias("first"), F.get("generation", 1).alias("last"))


_SHUFFLED_PROMPT = o.fill(
    P.ANSWER_SCIENCE,
    question="question",
    choices=(
        "array_to_string(list_transform(ord, lambda i, k: '(' || chr(CAST(64 + k AS INT)) || ') ' || opts[i + 1]),"
        " chr(10))"
    ),
)


@query(
    o.with_tables(
        f"""SELECT qid, attempt, array_to_string(ord, ',') AS shuffled_order,
        chr(CAST(64 + list_position(ord, answer_index) AS INT)) AS correct_label,
        chr(92) || 'boxed{{' || chr(CAST(65 + {_digit('p', '0')} % 4 AS INT)) || '}}' AS generation
        FROM (SELECT *, {_SHUFFLED_PROMPT} AS p FROM ({SHUFFLES}))""",
        "fx_mcq",
    )
)
def generate_mcq_stub(spark, sf):
    run = RUN.answer_mcq(_mcq(spark, sf), stubs.letter_model, ["qid"], 3)
    each = run.select("qid", F.posexplode("attempts").alias("attempt", "a"))
    return each.select(
        "qid",
        F.col("attempt").cast("bigint"),
        F.array_join("a.shuffled_order", ",").alias("shuffled_order"),
        "a.correct_label",
        "a.generation",
    )


@query(
    o.with_tables(
        f"""SELECT qid, analysis, {o.decision('analysis')} AS decision
        FROM (SELECT qid, {_decided(_DECIDE, '0')} AS analysis FROM fx_questions)""",
        "fx_questions",
    )
)
def decide_stub(spark, sf):
    run = RUN.decide(fx.questions(spark, sf).drop("decision"), stubs.decision_model, "math")
    return run.select("qid", "analysis", "decision")


_SAMPLES = f"""
SELECT qid, k, t, {o.decision('t')} AS d
FROM (SELECT qid, k, {_decided(_DECIDE, 'k')} AS t FROM fx_questions, (SELECT unnest(range(0, 4)) AS k))"""
_ROLLOUTS = f"""
SELECT qid, CAST(count_if(d = 0) AS INT) AS count_0, CAST(count_if(d = 1) AS INT) AS count_1,
  CAST(count_if(d = -1) AS INT) AS count_invalid,
  coalesce(arg_min(t, k) FILTER (WHERE d = 0), '') AS example_0,
  coalesce(arg_min(t, k) FILTER (WHERE d = 1), '') AS example_1
FROM ({_SAMPLES}) GROUP BY qid"""


@query(o.with_tables(_ROLLOUTS, "fx_questions"))
def rollouts_stub(spark, sf):
    run = RUN.rollouts(fx.questions(spark, sf), stubs.decision_model, "math", 4)
    return run.select("qid", "count_0", "count_1", "count_invalid", "example_0", "example_1")


@query(
    o.with_tables(
        f"""SELECT qid, count_1 AS dfw_n_self, count_0 AS dfw_n_delegate, count_invalid AS dfw_n_invalid
        FROM ({_ROLLOUTS}) WHERE count_0 > 0 AND count_1 > 0""",
        "fx_questions",
    )
)
def build_diversified_stub(spark, sf):
    run = RUN.build_diversified(fx.questions(spark, sf), stubs.decision_model, "math", 4)
    return run.select("qid", "dfw_n_self", "dfw_n_delegate", "dfw_n_invalid")


@query(
    o.with_tables(
        f"""SELECT qid, {_hash(o.fill(P.RATIONALE_TEACHER, query=_QUERY_MATH, decision="'DELEGATE'"))} AS label_0_analysis,
        {_hash(o.fill(P.RATIONALE_TEACHER, query=_QUERY_MATH, decision="'SELF_SOLVE'"))} AS label_1_analysis
        FROM fx_graded""",
        "fx_graded",
    )
)
def rationales_stub(spark, sf):
    run = RUN.rationales(fx.graded(spark, sf), stubs.text_model, "teacher")
    return run.select("qid", "label_0_analysis", "label_1_analysis")


_OLD = "CASE WHEN choices LIKE '%PROMO%' THEN 'kept' WHEN choices LIKE '%SMALL%' THEN 'Error: Timeout' END"


@query(
    o.with_tables(
        f"""SELECT qid, CASE WHEN choices LIKE '%PROMO%' THEN 'kept'
        ELSE {_hash(o.fill(P.RATIONALE_SELF, query=_QUERY_MATH, decision=_WORD))} END AS routing_analysis
        FROM fx_graded""",
        "fx_graded",
    )
)
def rationales_resume_stub(spark, sf):
    """A second run: rows with a text keep it, rows with an error or nothing are asked."""
    half_done = fx.graded(spark, sf).withColumn("routing_analysis", F.expr(_OLD))
    return RUN.rationales(half_done, stubs.text_model, "self").select("qid", "routing_analysis")


# A result table that is not finished: errors for some questions, nothing for others.
_STORED = (
    "SELECT qid, CASE o_orderstatus WHEN 'F' THEN 'text' ELSE 'Error: Timeout' END AS generation"
    " FROM (SELECT o_orderkey AS qid, o_orderstatus FROM orders) WHERE o_orderstatus <> 'P'"
)


def _stored(spark, sf):
    done = fx.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    text = F.when(F.col("o_orderstatus") == "F", "text").otherwise("Error: Timeout")
    return done.select(F.col("o_orderkey").alias("qid"), text.alias("generation"))


@query(
    o.with_tables(
        f"""SELECT q.qid, q.question FROM fx_questions q LEFT JOIN ({_STORED}) s ON q.qid = s.qid
        WHERE s.generation IS NULL OR starts_with(s.generation, 'Error')""",
        "fx_questions",
    )
)
def pending(spark, sf):
    q = fx.questions(spark, sf).select("qid", "question")
    return N.pending_keys(q, _stored(spark, sf), ["qid"], "generation")


@query(
    f"SELECT qid, generation FROM ({_STORED}) WHERE generation IS NULL OR starts_with(generation, 'Error')"
)
def pending_in_table(spark, sf):
    return N.pending(_stored(spark, sf), "generation")


@query(
    o.with_tables(
        f"SELECT qid, question FROM fx_questions WHERE qid NOT IN (SELECT qid FROM ({_STORED}))", "fx_questions"
    )
)
def remaining(spark, sf):
    q = fx.questions(spark, sf).select("qid", "question")
    return J.remaining(q, _stored(spark, sf), ["qid"])


_NOT_STORED = o.with_tables(
    f"SELECT qid, question FROM fx_questions WHERE qid NOT IN (SELECT qid FROM ({_STORED}))", "fx_questions"
)


@query(_NOT_STORED)
def remaining_filtered(spark, sf):
    """Only questions that may have a result meet the results."""
    q = fx.questions(spark, sf).select("qid", "question")
    return J.remaining(q, _stored(spark, sf), ["qid"], bloom=True, max_broadcast_rows=0)


@query(
    o.with_tables(
        f"SELECT qid, question FROM fx_questions WHERE qid IN (SELECT qid FROM ({_STORED}) WHERE generation = 'text')",
        "fx_questions",
    )
)
def restrict_filtered(spark, sf):
    q = fx.questions(spark, sf).select("qid", "question")
    done = _stored(spark, sf).filter("generation = 'text'")
    return J.restrict(q, done, ["qid"], bloom=True, max_broadcast_rows=0)


@query(
    """SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_type = 'error' AS INT), event_id DESC) AS rn
      FROM events) WHERE rn = 1"""
)
def latest_result(spark, sf):
    events = fx.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return J.latest_results(events, ["user_id"], F.col("event_type") == "error", "event_id")


_ALL_ANSWERED = o.with_tables(
    f"SELECT qid, {_number(_ANSWER, '0')} AS generation FROM fx_questions", "fx_questions"
)


def _answer(df):
    run = RUN.answer_questions(df, stubs.number_model, "math", 1)
    return run.select("qid", F.get("generation", 0).alias("generation"))


@query(_ALL_ANSWERED)
def incremental_batch(spark, sf):
    """Two runs: questions with a decision first, then the whole table."""
    q = fx.questions(spark, sf).select("qid", "question", "decision")
    path = fresh_path(spark, "incremental")
    I.run_incremental(q.filter("decision IS NOT NULL"), path, _answer, ["qid"], "generation")
    return I.run_incremental(q, path, _answer, ["qid"], "generation").select("qid", "generation")


@query(_ALL_ANSWERED)
def choose_model(spark, sf):
    """A model found by its provider's name, in any case."""
    factory = N.choose_model({"Stub": stubs.number_model, "other": stubs.text_model}, "STUB")
    run = RUN.answer_questions(fx.questions(spark, sf), factory, "math", 1)
    return run.select("qid", F.get("generation", 0).alias("generation"))


@query(o.with_tables(f"SELECT qid, {_THREE} AS texts FROM fx_questions", "fx_questions"))
def incremental_array(spark, sf):
    """Arrays of answers, kept slice by slice; the second run takes up what the first left out."""
    q = fx.questions(spark, sf).select("qid", "question", "decision")
    path = fresh_path(spark, "incremental")

    def job(todo):
        return RUN.answer_questions(todo, stubs.number_model, "math", 3).select("qid", "generation")

    I.run_incremental(q.filter("decision IS NOT NULL"), path, job, ["qid"], "generation", slices=3)
    found = I.run_incremental(q, path, job, ["qid"], "generation", slices=2)
    return found.select("qid", F.array_join("generation", "|").alias("texts"))


@query(_ALL_ANSWERED)
def incremental_batch_then_stream(spark, sf):
    """A stream to the folder of a batch run: it leaves its rows alone and asks the other keys only."""
    path = fresh_path(spark, "both")
    q = fx.questions(spark, sf).select("qid", "question", "decision")
    I.run_incremental(q.filter("decision = 1"), f"{path}/rows", _answer, ["qid"], "generation")
    orders = fx.table(spark, sf, "orders")

    def ready(stream):
        return stream.selectExpr(*(f"{fx.QUESTIONS[name]} AS {name}" for name in ("qid", "question")))

    run = I.stream_incremental(
        spark, sf, orders.schema, f"{path}/rows", _answer, f"{path}/progress", "orders.parquet", ready=ready,
        key=["qid"], output="generation",
    )
    run.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("qid", "generation")


@query(_ALL_ANSWERED)
def incremental_compacted(spark, sf):
    """Two runs, their folders made one with the newest good row per key, and a third run that finds all done."""
    q = fx.questions(spark, sf).select("qid", "question", "decision")
    path = fresh_path(spark, "compacted")
    I.run_incremental(q.filter("decision IS NOT NULL"), path, _answer, ["qid"], "generation", slices=3)
    I.run_incremental(q, path, _answer, ["qid"], "generation")
    I.compact(spark, path, ["qid"], "generation")
    snapshots.vacuum(spark, path, older_than_hours=0)
    return I.run_incremental(q, path, _answer, ["qid"], "generation").select("qid", "generation")


@query(o.with_tables("SELECT qid, CAST(1 AS BIGINT) AS times FROM fx_questions", "fx_questions"))
def incremental_stream_keyed(spark, sf):
    """Keys that come back in later files of a stream are asked once."""
    q = fx.questions(spark, sf).select("qid", "question")
    path = fresh_path(spark, "keyed")
    for part in range(3):  # two thirds of the questions each
        q.filter(F.col("qid") % 3 != part).write.mode("append").parquet(f"{path}/in")
    run = I.stream_incremental(
        spark, f"{path}/in", q.schema, f"{path}/rows", _answer, f"{path}/progress", max_files=1,
        key=["qid"], output="generation",
    )
    run.awaitTermination()
    return S.read_results(spark, f"{path}/rows").groupBy("qid").agg(F.count("*").alias("times"))


@query(_ALL_ANSWERED)
def incremental_stream(spark, sf):
    path = fresh_path(spark, "stream")
    orders = fx.table(spark, sf, "orders")

    def ready(stream):
        return stream.selectExpr(
            *(f"{fx.QUESTIONS[name]} AS {name}" for name in ("qid", "question"))
        )

    run = I.stream_incremental(
        spark, sf, orders.schema, f"{path}/rows", _answer, f"{path}/progress", "orders.parquet", ready=ready
    )
    run.awaitTermination()
    return I.newest(spark, f"{path}/rows", ["qid"], "generation").select("qid", "generation")


@query(REWARD_REPORT)
def reward_stream(spark, sf):
    path = fresh_path(spark, "rewards")
    schema = fx.table(spark, sf, "lineitem").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(sf)
        .selectExpr(
            f"{fx.ATTEMPTS['qid']} AS qid", f"{fx.ATTEMPTS['rollout']} AS rollout", "l_orderkey % 10 AS step"
        )
    )
    run = I.stream_reward_report(
        stream, f"{path}/rows", f"{path}/progress", "rollout", F.col("qid") % 2
    )
    run.awaitTermination()
    return rounded(I.newest_report(spark, f"{path}/rows"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_round_trip(spark, sf):
    docs = fx.table(spark, sf, "documents")
    path = fresh_path(spark, "csv")
    S.write_table(docs, path, "csv")
    return S.read_csv(spark, path, docs.schema)


_EDGES = """CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' || text || ' '
    WHEN 3 THEN text || chr(10) WHEN 4 THEN chr(13) || text || chr(13) WHEN 5 THEN '"' || text || chr(92)
    WHEN 6 THEN chr(9) || text || chr(92) || '"' ELSE text || ',' || chr(13) || chr(10) END"""


@query(f"SELECT doc_id, {_EDGES} AS text FROM documents")
def csv_round_trip_edges(spark, sf):
    """Texts with white space, quotes and line ends at their edges, empty and null ones."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.expr(_EDGES).alias("text"))
    path = fresh_path(spark, "csv")
    S.write_table(docs, path, "csv")
    return S.read_csv(spark, path, docs.schema)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_by_ranges(spark, sf):
    """Files with line ends in their cells, spread over tasks by byte ranges."""
    docs = fx.table(spark, sf, "documents")
    path = fresh_path(spark, "csv")
    S.write_table(docs, path, "csv")
    return S.read_csv(spark, path, docs.schema, by_ranges=True)


_LONG_IDS = {"low": "-9007199254740993 - doc_id", "high": "9223372036854775807 - doc_id * 3", "text": "text"}


@query(f"SELECT {', '.join(f'{column} AS {name}' for name, column in _LONG_IDS.items())} FROM documents")
def csv_round_trip_ids(spark, sf):
    """Ids that need all 64 bits come back as they were."""
    docs = fx.table(spark, sf, "documents").selectExpr(*(f"{column} AS {name}" for name, column in _LONG_IDS.items()))
    path = fresh_path(spark, "csv")
    S.write_table(docs, path, "csv")
    return S.read_csv(spark, path, docs.schema)


@query("SELECT doc_id, lang FROM documents")
def read_training(spark, sf):
    path = fresh_path(spark, "training")
    S.write_table(fx.table(spark, sf, "documents").select("doc_id", "lang"), path)
    return S.read_training(spark, path)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def write_splits(spark, sf):
    path = fresh_path(spark, "splits")
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    S.write_splits(fx.table(spark, sf, "documents").select("doc_id", split.alias("split")), path)
    return S.read_table(spark, path)


@query("SELECT doc_id, 'm' || CAST(doc_id % 3 AS VARCHAR) AS model FROM documents")
def read_runs(spark, sf):
    path, docs = fresh_path(spark, "models"), fx.table(spark, sf, "documents").select("doc_id")
    for i in range(3):
        S.write_table(docs.filter(F.col("doc_id") % 3 == i), f"{path}/m{i}")
    return S.read_runs(spark, path + "/{model}", ["m0", "m1", "m2"])


@query(
    """SELECT doc_id, 'm' || CAST(doc_id % 3 AS VARCHAR) AS model, CASE WHEN doc_id % 3 <> 1 THEN lang END AS lang,
    CASE WHEN doc_id % 3 = 2 THEN n_chars END AS n_chars FROM documents"""
)
def read_runs_uneven(spark, sf):
    """Models whose tables have different columns."""
    path, docs = fresh_path(spark, "models"), fx.table(spark, sf, "documents")
    for i, columns in enumerate((["doc_id", "lang"], ["doc_id"], ["n_chars", "doc_id", "lang"])):
        S.write_table(docs.filter(F.col("doc_id") % 3 == i).select(*columns), f"{path}/m{i}")
    return S.read_runs(spark, path + "/{model}", ["m0", "m1", "m2"]).select("doc_id", "model", "lang", "n_chars")


@query(
    o.with_tables(
        """SELECT qid, model, source, CAST(n_wanted AS INT) AS n,
        coalesce((SELECT string_agg(a.generation, '|' ORDER BY a.attempt) FROM fx_answers a WHERE a.qid = q.qid), '')
          AS texts FROM fx_questions q""",
        "fx_answers",
    )
)
def csv_round_trip_arrays(spark, sf):
    answers = fx.answers(spark, sf).select("qid", "model", "source", "n_wanted", "generation")
    path = fresh_path(spark, "csv")
    S.write_table(answers, path, "csv")
    back = S.read_csv(spark, path, answers.schema)
    return back.select(
        "qid", "model", "source", F.col("n_wanted").alias("n"), F.array_join("generation", "|").alias("texts")
    )


@query(o.with_tables("SELECT qid, question, model FROM fx_questions", "fx_questions"))
def model_runs(spark, sf):
    """One folder per model, read back as a single table with a model column."""
    q = fx.questions(spark, sf).select("qid", "question", "model")
    path = fresh_path(spark, "runs")
    S.write_table(q, path, "parquet", partition_by=["model"])
    return S.read_table(spark, path)


@query(
    """SELECT o_orderkey AS question, o_orderstatus AS answer, 'ORDERS' AS source, o_totalprice FROM orders"""
)
def read_questions(spark, sf):
    return S.read_questions(
        spark,
        f"{sf}/orders.parquet",
        {"question": "o_orderkey", "answer": "o_orderstatus"},
        "ORDERS",
        keep=["o_totalprice"],
    )


@query(f"SELECT qid, generation, starts_with(generation, 'Error') AS failed FROM ({_STORED})")
def error_sentinel(spark, sf):
    s = _stored(spark, sf)
    return s.select("qid", "generation", is_error(F.col("generation")).alias("failed"))
