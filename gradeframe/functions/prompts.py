"""Prompt and completion text as column expressions.

A template is an ordinary format string. It is split once on the driver and becomes a
``concat`` of literals and columns; every template can be replaced by the caller.
"""

from string import Formatter

from pyspark.sql import Column, functions as F

from gradeframe.functions.options import choices_text
from gradeframe.functions.parsing import DELEGATE, SELF_SOLVE
from gradeframe.schemas import check_domain, one_of

ANSWER_MATH = (
    "Question: {question}\n"
    "Work it out, then give only the final result inside \\boxed{{}}."
)
ANSWER_SCIENCE = (
    "Question: {question}\n"
    "Choices:\n{choices}\n\n"
    "Pick one option and give its letter alone inside \\boxed{{}}."
)

_CHOICE_RULES = (
    f"Say {SELF_SOLVE} if you expect to answer it correctly yourself.\n"
    f"Say {DELEGATE} if it should go to a stronger model.\n"
)
_TASK = "Judge whether you can answer the query below correctly. Do not answer it.\n" + _CHOICE_RULES
_DECISION_FORMAT = f"<decision>\n{SELF_SOLVE} or {DELEGATE}\n</decision>"
_ANALYSIS_FORMAT = "<analysis>\nYour reasons\n</analysis>\n\n" + _DECISION_FORMAT

DECIDE_ONLY = f"{_TASK}\nReply in this form:\n{_DECISION_FORMAT}\n\nQuery:\n{{query}}"
DECIDE_WITH_ANALYSIS = f"{_TASK}\nReply in this form:\n{_ANALYSIS_FORMAT}\n\nQuery:\n{{query}}"

RATIONALE_TEACHER = (
    "A model was given this query:\n{query}\n\n"
    f"{SELF_SOLVE} means the model answers it correctly, {DELEGATE} that it does not.\n"
    "The right label here is {decision}.\n"
    "Speaking as that model, in the first person, explain why the label is {decision}. "
    "Do not answer the query."
)
RATIONALE_SELF = (
    "You were given this query: {query}\n\n"
    f"{SELF_SOLVE} means you answer it correctly, {DELEGATE} that you do not.\n"
    "The right label here is {decision}.\n"
    "Explain why your label is {decision}. Do not answer the query."
)

TRAIN_BODY = (
    "Judge whether you can answer the query below correctly.\n"
    + _CHOICE_RULES
    + "\nReply in this form:\n{format}\n\nQuery:\n{query}"
)
TRAIN_QUERY = {"math": "{question}", "science": "Question: {question}\nChoices:\n{choices}"}
RESPONSE_LABEL = "<decision>\n{decision}\n</decision>"
RESPONSE_ANALYSIS = "<analysis>\n{analysis}\n</analysis>\n\n" + RESPONSE_LABEL

TRAIN_MODES = ("label", "teacher", "self")


def placeholders(template: str) -> set[str]:
    """Names that a template asks for."""
    return {field for _, field, _, _ in Formatter().parse(template) if field is not None}


def fill(template: str, **columns: Column) -> Column:
    """The template with its placeholders replaced by columns; null if any used column is."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            if field not in columns:
                raise ValueError(f"template needs {field!r}, given {sorted(columns)}")
            parts.append(columns[field])
    return F.concat(*parts)


def shown(text: Column) -> Column:
    """A text for display: null becomes an empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def query_text(
    domain: str,
    question: Column,
    options: Column | None = None,
    choices: Column | None = None,
) -> Column:
    """``Question: ...``; for science also the choices block."""
    head = F.concat(F.lit("Question: "), question)
    if check_domain(domain) == "math":
        return head
    return F.concat(head, F.lit("\nChoices:\n"), choices_text(options, choices))


def query_text_by_presence(question: Column, options: Column | None = None) -> Column:
    """The choices block appears exactly for rows that have options."""
    plain = query_text("math", question)
    if options is None:
        return plain
    return F.when(options.isNotNull(), query_text("science", question, options)).otherwise(plain)


def answer_prompt(
    domain: str,
    question: Column,
    options: Column | None = None,
    choices: Column | None = None,
    template: str | None = None,
) -> Column:
    if check_domain(domain) == "math":
        return fill(template or ANSWER_MATH, question=question)
    return fill(
        template or ANSWER_SCIENCE, question=question, choices=choices_text(options, choices)
    )


def decision_prompt(query: Column, binary_only: bool = False, template: str | None = None) -> Column:
    return fill(template or (DECIDE_ONLY if binary_only else DECIDE_WITH_ANALYSIS), query=query)


def rationale_prompt(
    query: Column, decision_word: Column, voice: str, template: str | None = None
) -> Column:
    one_of(voice, ("self", "teacher"), "voice")
    default = RATIONALE_SELF if voice == "self" else RATIONALE_TEACHER
    return fill(template or default, query=query, decision=decision_word)


def train_template(domain: str, mode: str) -> str:
    """User-turn template of a training pair for a domain and mode."""
    check_domain(domain)
    one_of(mode, TRAIN_MODES, "mode")
    form = _DECISION_FORMAT if mode == "label" else _ANALYSIS_FORMAT
    return TRAIN_BODY.format(format=form, query=TRAIN_QUERY[domain])


def train_prompt(
    domain: str, mode: str, question: Column, choices: Column | None = None
) -> Column:
    columns = {"question": question}
    if domain == "science":
        if choices is None:
            raise ValueError("science prompts need a choices column")
        columns["choices"] = choices
    return fill(train_template(domain, mode), **columns)


def rollout_prompt(query: Column) -> Column:
    """Training prompt for sampled decisions: reasons and decision are both asked for."""
    return fill(TRAIN_BODY.format(format=_ANALYSIS_FORMAT, query="{query}"), query=query)


def response_template(mode: str) -> str:
    """Reply template of a training pair."""
    one_of(mode, TRAIN_MODES, "mode")
    return RESPONSE_LABEL if mode == "label" else RESPONSE_ANALYSIS


def train_response(mode: str, decision_word: Column, analysis: Column | None = None) -> Column:
    template = response_template(mode)
    if "analysis" not in placeholders(template):
        return fill(template, decision=decision_word)
    if analysis is None:
        raise ValueError(f"mode {mode!r} needs an analysis column")
    return fill(template, decision=decision_word, analysis=shown(analysis))
