"""SQL of the checking engine: the text rules again, in another regular-expression dialect."""

from gradeframe.catalog.fixtures import CTES

NEEDS = {"fx_answers": ["fx_questions"]}


def with_tables(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the named fixture tables and further named queries."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    parts = [f"{n} AS ({CTES[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def after_think(x: str) -> str:
    return f"split({x}, '</think>')[-1]"


def boxed(x: str) -> str:
    return rf"regexp_extract_all({after_think(x)}, '\\boxed\{{(.*?)\}}', 1)[-1]"


def letter(x: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    pattern = rf"(?:^|{edge})([A-Z])(?:$|{edge})"
    return f"nullif(regexp_extract(coalesce({boxed(x)}, {after_think(x)}), '{pattern}', 1), '')"


def decision(x: str) -> str:
    tagged = rf"regexp_extract_all({x}, '(?i)<decision>\s*(SELF_SOLVE|DELEGATE)', 1)[-1]"
    bare = rf"regexp_extract_all({x}, '(?i)\b(SELF_SOLVE|DELEGATE)\b', 1)[-1]"
    return (
        f"CASE upper(coalesce({tagged}, {bare})) WHEN 'SELF_SOLVE' THEN 1"
        " WHEN 'DELEGATE' THEN 0 ELSE -1 END"
    )


def gold(answer: str = "answer", source: str = "source") -> str:
    # size marks before a bracket that opens or closes, then white space on the inner side of round ones
    sized = rf"regexp_replace({answer}, '\\left\s*([(\[])|\\right\s*([)\]])', '\1\2', 'g')"
    plain = rf"regexp_replace({sized}, '(\()\s+|\s+(\))', '\1\2', 'g')"
    tail = rf"replace({strip(f'regexp_extract({answer}, {text(r"####\s*(.+)")}, 1)')}, ',', '')"
    return (
        f"CASE WHEN lower({source}) LIKE '%math500%' THEN {plain}"
        f" WHEN lower({source}) LIKE '%gsm8k%' AND {answer} LIKE '%####%' THEN {tail}"
        f" ELSE {answer} END"
    )


def math_correct(x: str, gold_sql: str) -> str:
    return f"coalesce(CAST({strip(boxed(x))} = {strip(gold_sql)} AS INT), 0)"


def mcq_correct(x: str, label: str) -> str:
    return f"coalesce(CAST({letter(x)} = {strip(label)} AS INT), 0)"


def majority(n_correct: str, n: str) -> str:
    return f"CAST({n_correct} >= {n} // 2 + 1 AS INT)"


def pick(seed_text: str, names: int = 16) -> str:
    """First hex digit of a hash as a number, for the stub model."""
    return f"CAST(strpos('0123456789abcdef', substr(md5({seed_text}), 1, 1)) - 1 AS INT)"


def fill(template: str, **columns: str) -> str:
    """A prompt template as a concatenation."""
    from string import Formatter

    parts = []
    for words, field, _, _ in Formatter().parse(template):
        if words:
            parts.append(text(words))
        if field is not None:
            parts.append(columns[field])
    return " || ".join(parts)


REPORT_COLUMNS = """
  CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count_if(d IS NOT DISTINCT FROM -1) AS BIGINT) AS n_invalid,
  CAST(count_if(d IS DISTINCT FROM -1) AS BIGINT) AS n_valid,
  CAST(count_if(d IS NOT DISTINCT FROM 1) AS BIGINT) AS n_pred_self,
  CAST(count_if(d IS NOT DISTINCT FROM 0) AS BIGINT) AS n_pred_delegate,
  CAST(count_if(d = 1 AND t = 1) AS DOUBLE) AS s1,
  CAST(count_if(d = 0 AND t = 1) AS DOUBLE) AS d1,
  CAST(count_if(d = 0 AND t = 0) AS DOUBLE) AS d0,
  CAST(count_if(d = 1 AND t = 0) AS DOUBLE) AS s0,
  CAST(count_if(d IS DISTINCT FROM -1 AND t = 1 AND d IS DISTINCT FROM 1) AS DOUBLE) AS miss1,
  CAST(count_if(d IS DISTINCT FROM -1 AND t = 0 AND d IS DISTINCT FROM 0) AS DOUBLE) AS miss0,
  CAST(count_if(d IS DISTINCT FROM -1 AND t = 1) AS DOUBLE) AS true_valid,
  CAST(count_if(t = 1) AS DOUBLE) AS true_all
"""


def report(rows: str, by: str = "") -> str:
    """Routing metrics over rows (d, t)."""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}total_rows, n_invalid, round(n_invalid / CAST(total_rows AS DOUBLE), 6) AS invalid_share,
  n_valid, n_pred_self, n_pred_delegate, round(p_self, 6) AS p_self, round(p_delegate, 6) AS p_delegate,
  round(CASE WHEN n_pred_self > 0 AND n_pred_delegate > 0 AND se > 0 THEN (p_self - p_delegate) / se
        ELSE 0.0 END, 6) AS cds,
  round((s1 + d0) / nullif(n_valid, 0), 6) AS accuracy,
  round(CAST(n_pred_self AS DOUBLE) / nullif(n_valid, 0), 6) AS ssr_pred,
  round(true_valid / nullif(n_valid, 0), 6) AS ssr_true,
  round(f1_self, 6) AS f1_self, round(f1_delegate, 6) AS f1_delegate,
  round((f1_self + f1_delegate) / 2, 6) AS macro_f1,
  round(true_all / total_rows, 6) AS base_solve_rate
FROM (SELECT *,
    sqrt(p_self * (1 - p_self) / nullif(n_pred_self, 0)
       + p_delegate * (1 - p_delegate) / nullif(n_pred_delegate, 0)) AS se
  FROM (SELECT *, coalesce(s1 / nullif(n_pred_self, 0), 0) AS p_self,
      coalesce(d1 / nullif(n_pred_delegate, 0), 0) AS p_delegate,
      coalesce(2 * s1 / nullif(2 * s1 + s0 + miss1, 0), 0) AS f1_self,
      coalesce(2 * d0 / nullif(2 * d0 + d1 + miss0, 0), 0) AS f1_delegate
    FROM (SELECT {lead}{REPORT_COLUMNS} FROM ({rows}) {group})))
"""
