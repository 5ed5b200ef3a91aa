"""Evaluation-report and rollout queries."""

from pyspark.sql import functions as F

from gradeframe.catalog import fixtures as fx, oracle as o
from gradeframe.catalog.grading import KEY, _ARRAY, _ARRAY_MCQ, _LONG
from gradeframe.catalog.registry import query
from gradeframe.functions.metrics import rounded
from gradeframe.operators import grading as G, joins as J, reports as R, rollouts as D
from gradeframe.plans import evaluation as E

_JOINED = f"""SELECT p.model, p.decision AS d, t.is_correct AS t
FROM fx_questions p JOIN ({_LONG}) t ON p.qid = t.qid"""


def _truth(spark, sf):
    return G.grade_math_long(fx.questions(spark, sf), fx.attempts(spark, sf), KEY)


@query(
    o.with_tables(
        f"SELECT p.qid, p.model, p.decision, t.is_correct FROM fx_questions p JOIN ({_LONG}) t ON p.qid = t.qid",
        "fx_questions",
        "fx_attempts",
    )
)
def attach_truth(spark, sf):
    preds = fx.questions(spark, sf).select("qid", "model", "decision")
    return J.attach_truth(preds, _truth(spark, sf), KEY, measure=preds.select("qid"))


@query(
    """SELECT CAST(count_if(t = 0) AS BIGINT) AS keys_without_truth,
    CAST(count_if(p = 0) AS BIGINT) AS keys_without_prediction,
    CAST(count_if(t > 1) AS BIGINT) AS repeated_truth_keys,
    CAST(count_if(p > 0 AND t > 0) AS BIGINT) AS matched_keys
    FROM (SELECT k, sum(p) AS p, sum(t) AS t FROM (
      SELECT o_orderkey AS k, 1 AS p, 0 AS t FROM orders
      UNION ALL SELECT l_orderkey, 0, 1 FROM lineitem) GROUP BY k)"""
)
def alignment_report(spark, sf):
    preds = fx.questions(spark, sf).select("qid")
    return J.alignment_report(preds, fx.attempts(spark, sf).select("qid"), KEY)


@query(o.with_tables(o.report(_JOINED), "fx_questions", "fx_attempts"))
def decision_report(spark, sf):
    return rounded(R.decision_report_joined(fx.questions(spark, sf), _truth(spark, sf), KEY))


@query(o.with_tables(o.report(_JOINED, "model"), "fx_questions", "fx_attempts"))
def decision_report_by_model(spark, sf):
    return rounded(
        R.decision_report_joined(fx.questions(spark, sf), _truth(spark, sf), KEY, by=["model"])
    )


@query(
    o.with_tables(
        o.report(f"SELECT model, coalesce(d, -1) AS d, t FROM ({_JOINED})", "model"),
        "fx_questions",
        "fx_attempts",
    )
)
def decision_report_null_invalid(spark, sf):
    return rounded(
        R.decision_report_joined(
            fx.questions(spark, sf), _truth(spark, sf), KEY, by=["model"], null_policy="invalid"
        )
    )


_SETS = [["model"], ["source"], ["model", "source"], []]


def _levels(one, rows: str) -> str:
    """The SQL of a report for each grouping of ``_SETS``, one after the other."""
    parts = []
    for group in _SETS:
        missing = {c: f"CAST(NULL AS VARCHAR) AS {c}" for c in ("model", "source") if c not in group}
        named = ", ".join([*missing.values(), f"'{','.join(group)}' AS level"])
        parts.append(f"SELECT {named}, * FROM ({one(rows, ', '.join(group))})")
    return " UNION ALL BY NAME ".join(parts)


@query(
    o.with_tables(
        _levels(
            o.report,
            f"SELECT p.model, p.source, p.decision AS d, t.is_correct AS t FROM fx_questions p JOIN ({_ARRAY}) t ON p.qid = t.qid",
        ),
        "fx_answers",
    )
)
def decision_report_totals(spark, sf):
    """Per model, per source, per both and in total, from one scan."""
    graded = G.grade(fx.answers(spark, sf), "generation", "math")
    return rounded(R.decision_report_sets(graded, _SETS))


def _accuracies(rows: str, by: str) -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {lead}CAST(sum(is_correct) AS BIGINT) AS n_correct, CAST(count(is_correct) AS BIGINT) AS n,
    round(avg(is_correct), 6) AS accuracy FROM ({rows}) {group}"""


@query(
    o.with_tables(
        _levels(
            _accuracies,
            f"SELECT p.model, p.source, t.is_correct FROM fx_questions p JOIN ({_ARRAY}) t ON p.qid = t.qid",
        ),
        "fx_answers",
    )
)
def solve_accuracy_totals(spark, sf):
    graded = G.grade(fx.answers(spark, sf), "generation", "math")
    return rounded(G.solve_accuracy_sets(graded, _SETS))


@query(o.report("SELECT 1 - toxic AS d, quality AS t FROM labels"))
def decision_report_labels(spark, sf):
    labels = fx.table(spark, sf, "labels").withColumn("decision", 1 - F.col("toxic"))
    return rounded(R.decision_report(labels, label="quality"))


@query(
    o.with_tables(
        "SELECT qid, decision FROM fx_questions WHERE decision IS DISTINCT FROM -1", "fx_questions"
    )
)
def valid_decisions(spark, sf):
    return R.valid_only(fx.questions(spark, sf)).select("qid", "decision")


_PHASES = f"""
SELECT q.model, p.phase, q.qid,
  max(coalesce({o.math_correct('a.generation', o.gold('q.answer', 'q.source'))}, 0)) AS is_correct
FROM fx_questions q CROSS JOIN (SELECT unnest(['pre', 'post']) AS phase) p
LEFT JOIN fx_attempts a ON a.qid = q.qid AND a.phase = p.phase GROUP BY q.model, p.phase, q.qid
"""
_RATIO = """
SELECT {by} pre_correct, pre_n, round(acc_pre, 6) AS acc_pre, post_correct, post_n,
  round(acc_post, 6) AS acc_post,
  round(CASE WHEN acc_pre > 0 THEN acc_post * 100.0 / acc_pre END, 6) AS capability_ratio,
  pre_n <> post_n AS count_mismatch
FROM (SELECT *, coalesce(CAST(pre_correct AS DOUBLE) / nullif(pre_n, 0), 0) AS acc_pre,
    coalesce(CAST(post_correct AS DOUBLE) / nullif(post_n, 0), 0) AS acc_post
  FROM (SELECT {by} CAST(count_if(phase = 'pre' AND is_correct = 1) AS BIGINT) AS pre_correct,
      CAST(count_if(phase = 'pre') AS BIGINT) AS pre_n,
      CAST(count_if(phase = 'post' AND is_correct = 1) AS BIGINT) AS post_correct,
      CAST(count_if(phase = 'post') AS BIGINT) AS post_n
    FROM ({rows}) {group}))
"""


def _phases(spark, sf):
    both = F.explode(F.array(F.lit("pre"), F.lit("post")))
    wanted = fx.questions(spark, sf).withColumn("phase", both)
    return G.grade_math_long(wanted, fx.attempts(spark, sf), ["qid", "phase"], carry=["model"])


@query(
    o.with_tables(
        _RATIO.format(by="", group="", rows=_PHASES), "fx_questions", "fx_attempts"
    )
)
def capability_ratio(spark, sf):
    return rounded(R.capability_ratio(_phases(spark, sf)))


@query(
    o.with_tables(
        _RATIO.format(by="model,", group="GROUP BY model", rows=_PHASES), "fx_questions", "fx_attempts"
    )
)
def capability_ratio_by_model(spark, sf):
    return rounded(R.capability_ratio(_phases(spark, sf), by=["model"]))


@query(
    """SELECT 'documents' AS kind, source AS value, CAST(count(*) AS BIGINT) AS n FROM documents
    WHERE source IS NOT NULL GROUP BY source"""
)
def value_counts(spark, sf):
    counts = R.value_counts(fx.table(spark, sf, "documents"), "source")
    return counts.select(F.lit("documents").alias("kind"), F.col("source").alias("value"), "n")


@query(
    """SELECT lang, CAST(count(*) AS BIGINT) AS n,
    round(count(*) / CAST((SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS DOUBLE), 4) AS share
    FROM documents WHERE lang IS NOT NULL GROUP BY lang"""
)
def value_shares(spark, sf):
    return R.value_counts(fx.table(spark, sf, "documents"), "lang", normalize=True)


@query(
    o.with_tables(
        "SELECT qid, round(avg(elapsed), 6) AS avg_generation_time FROM fx_attempts GROUP BY qid",
        "fx_attempts",
    )
)
def generation_time(spark, sf):
    return rounded(R.generation_time(fx.attempts(spark, sf), KEY))


@query(
    """SELECT CAST(count(value) AS BIGINT) AS n, round(avg(value), 4) AS avg_latency
    FROM events WHERE event_id >= 5"""
)
def latency_after_warmup(spark, sf):
    events = fx.table(spark, sf, "events")
    return rounded(R.latency_report(events, 5, "value", "event_id"), 4)


_COUNTS = f"""
SELECT qid, CAST(count_if(d = 0) AS INT) AS count_0, CAST(count_if(d = 1) AS INT) AS count_1,
  CAST(count_if(d = -1) AS INT) AS count_invalid,
  coalesce(arg_min(rollout, (attempt, rollout)) FILTER (WHERE d = 0), '') AS example_0,
  coalesce(arg_min(rollout, (attempt, rollout)) FILTER (WHERE d = 1), '') AS example_1
FROM (SELECT *, {o.decision('rollout')} AS d FROM fx_attempts) GROUP BY qid
"""


@query(o.with_tables(_COUNTS, "fx_attempts"))
def rollout_counts(spark, sf):
    return D.rollout_counts(fx.attempts(spark, sf), KEY)


def _diversity(spark, sf):
    return D.diversity_columns(D.rollout_counts(fx.attempts(spark, sf), KEY, examples=False))


@query(
    o.with_tables(
        f"""SELECT q.qid, q.question, q.source, q.answer, c.count_1 AS dfw_n_self,
        c.count_0 AS dfw_n_delegate, c.count_invalid AS dfw_n_invalid
        FROM ({_COUNTS}) c JOIN fx_questions q ON q.qid = c.qid WHERE c.count_0 > 0 AND c.count_1 > 0""",
        "fx_questions",
        "fx_attempts",
    )
)
def diversified(spark, sf):
    kept = D.diversified(_diversity(spark, sf))
    rows = fx.questions(spark, sf).select("qid", "question", "source", "answer")
    return J.lookup_join(rows, kept, KEY, "inner", measure=fx.attempts(spark, sf).select("qid"))


@query(
    o.with_tables(
        f"""SELECT q.qid, q.question FROM fx_questions q
        WHERE q.qid IN (SELECT qid FROM ({_COUNTS}) WHERE count_0 > 0 AND count_1 > 0)""",
        "fx_questions",
        "fx_attempts",
    )
)
def restrict_to_diversified(spark, sf):
    kept = D.diversified(_diversity(spark, sf))
    questions = fx.questions(spark, sf).select("qid", "question")
    return J.restrict(questions, kept, KEY, measure=fx.attempts(spark, sf).select("qid"))


@query(
    o.with_tables(
        f"""SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count_if(k) AS BIGINT) AS n_kept,
        CAST(sum(count_1) FILTER (WHERE k) AS BIGINT) AS kept_self,
        CAST(sum(count_0) FILTER (WHERE k) AS BIGINT) AS kept_delegate,
        round(count_if(k) * 100.0 / CAST(count(*) AS DOUBLE), 6) AS kept_pct,
        round(sum(count_0) FILTER (WHERE k) * 100.0 / CAST(sum(count_0 + count_1) FILTER (WHERE k) AS DOUBLE), 6)
          AS delegate_pct
        FROM (SELECT *, count_0 > 0 AND count_1 > 0 AS k FROM ({_COUNTS}))""",
        "fx_attempts",
    )
)
def diversity_report(spark, sf):
    return rounded(D.diversity_report(_diversity(spark, sf)))


_REWARDS = f"""
SELECT qid, attempt, rollout, qid % 10 AS step,
  CASE WHEN {o.decision('rollout')} = qid % 2 THEN 1.0 ELSE -1.0 END AS reward FROM fx_attempts
"""


def _rewarded(spark, sf):
    a = fx.attempts(spark, sf).select(
        "qid", "attempt", "rollout", (F.col("qid") % 10).alias("step"), (F.col("qid") % 2).alias("label")
    )
    return D.with_reward(a, "rollout", "label").drop("label")


@query(
    o.with_tables(
        f"SELECT qid, attempt, rollout, step, CAST(reward AS DOUBLE) AS reward FROM ({_REWARDS})", "fx_attempts"
    )
)
def reward(spark, sf):
    return _rewarded(spark, sf)


REWARD_REPORT = o.with_tables(
    f"""SELECT step, CAST(count(*) AS BIGINT) AS n, CAST(count_if(reward = 1) AS BIGINT) AS n_plus,
    CAST(count_if(reward = -1) AS BIGINT) AS n_minus, round(avg(CAST(reward AS DOUBLE)), 6) AS mean_reward
    FROM ({_REWARDS}) GROUP BY step""",
    "fx_attempts",
)


@query(REWARD_REPORT)
def reward_report(spark, sf):
    return rounded(D.reward_report(_rewarded(spark, sf)))


@query(
    o.with_tables(
        o.report(
            f"SELECT p.model, p.decision AS d, t.is_correct AS t FROM fx_questions p JOIN ({_ARRAY}) t ON p.qid = t.qid",
            "model",
        ),
        "fx_answers",
    )
)
def evaluate_generations(spark, sf):
    """Decisions against answers that are graded on the fly."""
    answers = fx.answers(spark, sf)
    return rounded(
        E.evaluate_decisions(
            fx.questions(spark, sf).select("qid", "model", "decision"),
            grade_mode="generations",
            answers=answers.select("qid", "source", "answer", "generation"),
            generations="generation",
            domain="math",
            key=KEY,
            by=["model"],
        )
    )


_BEFORE_AFTER = f"""
SELECT source, 'pre' AS phase, is_correct FROM ({_ARRAY})
UNION ALL SELECT source, 'post', {o.majority('n_correct', 'n_attempts')} FROM ({_ARRAY_MCQ})
"""


@query(
    o.with_tables(
        _RATIO.format(by="source,", group="GROUP BY source", rows=_BEFORE_AFTER), "fx_answers"
    )
)
def before_after(spark, sf):
    """Two graded tables, here the math and the choice attempts, as before and after."""
    pre = G.grade(fx.answers(spark, sf), "generation", "math")
    post = G.grade(fx.answers(spark, sf), "attempts", "science")
    return rounded(R.capability_ratio(R.before_after(pre, post, ["source"]), by=["source"]))
