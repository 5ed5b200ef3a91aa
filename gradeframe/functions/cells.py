"""Reading list and dict cells of foreign CSV files.

Well-formed JSON cells are read by the JVM's VARIANT parser. Cells it refuses are cut into tokens there (strings,
names, whole numbers, signs), written as JSON token by token and parsed again, which reads Python literals and
mixed notation without touching words inside strings. What is left (tuples, fractions in literals, joined or
prefixed strings, rare escapes) goes to an Arrow function; all other rows pass it a null.
"""

import ast
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from gradeframe.functions.parsing import letter, strip
from gradeframe.schemas import require_columns

# Fixed values.
BLANK_CELLS = ("", "nan", "none")
UNESCAPED_BACKSLASH = r'\\(?!["\\/bfnrtu])'
JSON_NAMES = {"None": "null", "True": "true", "False": "false"}
# Escapes that mean the same in JSON and in Python.
SHARED_ESCAPE = r"\\[\\nrtbf]"
# A single backslash before "boxed" or "frac" reads as a JSON control escape.
CONTROL_ESCAPE = r"(?<!\\)(?:\\\\)*\\(?:boxed|frac)"
# Stand-ins for escaped quotes and backslashes while a cell is cut; cells that hold them are left to the Arrow function.
SINGLE, DOUBLE, BACKSLASH = "\ue010", "\ue011", "\ue012"
# Character loops are possessive, so that long strings need no stack.
TOKEN = r"""'[^']*+'|"[^"]*+"|[\p{L}_][\p{L}\p{N}_]*+|-?[0-9]++|(?s:.)"""
# Escapes that only Python has, or that mean something else there, and white space that is not read alike.
PYTHON_ESCAPE = r"\\[0-7NU\r\n]"
_WORD = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\W\d]\w*""", re.S)
_PYTHON_NAMES = {json_name: name for name, json_name in JSON_NAMES.items()}


def _plain(value):
    """The value in types that JSON can carry; anything else becomes its text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float) and math.isfinite(value):
        return value
    return str(value)


def _readings(cell: str):
    """JSON, JSON whose strings hold lone backslashes, and a literal in Python's or in mixed notation."""
    yield json.loads, cell
    yield json.loads, re.sub(UNESCAPED_BACKSLASH, r"\\\\", cell)
    yield ast.literal_eval, cell
    yield ast.literal_eval, _WORD.sub(lambda word: _PYTHON_NAMES.get(word[0], word[0]), cell)


def read_loose_cell(cell: str) -> str | None:
    """JSON text of the first reading that works, else null."""
    for read, text in _readings(cell):
        try:
            return json.dumps(_plain(read(text)))
        except Exception:
            continue
    return None


@F.pandas_udf(StringType())
def _read_loose(cells: pd.Series) -> pd.Series:
    return cells.map(lambda cell: None if cell is None else read_loose_cell(cell))


def _strict_json(cell: Column) -> Column:
    """VARIANT of a cell that is exactly one JSON value; null otherwise.

    The parser ignores text after the first value, so the cell is parsed inside an object and
    inside an array: no trailing text is legal in both.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), cell, F.lit("}")))
    in_array = F.json_array_length(F.concat(F.lit("["), cell, F.lit("]")))
    return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def _as_json(cell: Column) -> Column:
    """A literal cell written as JSON, token by token; what it cannot write is not JSON either."""
    text = cell
    for pair, stand_in in (("\\\\", BACKSLASH), ("\\'", SINGLE), ('\\"', DOUBLE)):
        text = F.replace(text, F.lit(pair), F.lit(stand_in))
    usable = ~cell.rlike(f"[{SINGLE}{DOUBLE}{BACKSLASH}]") & ~text.rlike(PYTHON_ESCAPE)
    text = F.regexp_replace(text, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
    for escape, code in (("\\a", "\\u0007"), ("\\v", "\\u000b"), ("\t", "\\t")):
        text = F.replace(text, F.lit(escape), F.lit(code))
    text = F.regexp_replace(text, r"\\(?![nrtbfu])", r"\\\\")
    tokens = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^\s$"))

    def written(all_tokens: Column) -> Column:
        def one(token: Column, at: Column) -> Column:
            inner = F.substring(token, F.lit(2), F.length(token) - 2)
            quoted = F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"'))
            before = F.when(at > 0, F.get(all_tokens, at - 1))
            last = (token == ",") & F.get(all_tokens, at + 1).isin("]", "}") & ~before.isin("[", "{", ",")
            found = F.when(token.startswith("'"), quoted)
            for name, json_name in JSON_NAMES.items():
                found = found.when(token == name, json_name)
            return found.when(last, "").otherwise(token)

        return F.array_join(F.transform(all_tokens, one), " ")

    # a lambda's own argument is computed once, where a named column would be copied to every use
    text = F.get(F.transform(F.array(tokens), written), F.lit(0))
    for stand_in, pair in ((BACKSLASH, "\\\\"), (SINGLE, "'"), (DOUBLE, '\\"')):
        text = F.replace(text, F.lit(stand_in), F.lit(pair))
    return F.when(usable, text)


def ingest_cells(df: DataFrame, col: str, out: str = "value", fallback: bool | str = True) -> DataFrame:
    """``df`` plus VARIANT ``out`` and STRING ``parse_status``.

    Status is ``blank``, ``json``, ``json_control`` (read as JSON, but a lone backslash was taken
    for a control escape), ``quoted`` (single-quoted, read by the JVM), ``fallback`` (read in a looser
    way) or ``failed``. ``fallback="native"`` plans no Python and so gives up on the cells that need it;
    ``False`` gives up on all cells that are neither JSON nor simply quoted.
    """
    require_columns(df, [col])
    cell = strip(F.col(col).cast("string"))
    blank = cell.isNull() | F.lower(cell).isin(*BLANK_CELLS)
    # JSON without double quotes has no strings, hence no single quotes either.
    single_quoted = ~F.col("_cell").contains('"') & F.col("_cell").contains("'")
    # Without double quotes, and with shared escapes only, single quotes can but delimit strings.
    swapped = F.replace("_cell", F.lit("'"), F.lit('"'))
    odd_escape = F.regexp_replace("_cell", SHARED_ESCAPE, "").contains("\\")
    simple = F.col("_json").isNull() & single_quoted & ~odd_escape
    first = (
        df.withColumn("_cell", F.when(~blank, cell))
        .withColumn("_json", F.when(~single_quoted, _strict_json(F.col("_cell"))))
        .withColumn("_quoted", F.when(simple, _strict_json(swapped)))
    )
    refused = F.when(F.col("_json").isNull() & F.col("_quoted").isNull(), F.col("_cell"))
    nothing = F.lit(None).cast("variant")
    escaped = F.regexp_replace(refused, UNESCAPED_BACKSLASH, r"\\\\")
    first = first.withColumn("_escaped", _strict_json(escaped) if fallback else nothing)
    literal = F.when(F.col("_escaped").isNull(), _as_json(refused))
    first = first.withColumn("_literal", _strict_json(literal) if fallback else nothing)
    left = F.when(F.col("_escaped").isNull() & F.col("_literal").isNull(), refused)
    loose = _read_loose(left) if fallback and fallback != "native" else F.lit(None).cast("string")
    read_loose = F.coalesce("_escaped", "_literal", F.try_parse_json("_loose"))
    control = F.col("_cell").rlike(CONTROL_ESCAPE)
    status = (
        F.when(F.col("_cell").isNull(), "blank")
        .when(F.col("_json").isNotNull() & control, "json_control")
        .when(F.col("_json").isNotNull(), "json")
        .when(F.col("_quoted").isNotNull(), "quoted")
        .when(F.col("_read").isNotNull(), "fallback")
        .otherwise("failed")
    )
    return (
        first.withColumn("_loose", loose)
        .withColumn("_read", read_loose)
        .withColumn(out, F.coalesce("_json", "_quoted", "_read"))
        .withColumn("parse_status", status)
        .drop("_cell", "_json", "_quoted", "_escaped", "_literal", "_loose", "_read")
    )


def as_list(value: Column) -> Column:
    """Texts of a cell: null is empty, a scalar is one text, a list is itself."""
    nothing = F.array().cast("array<string>")
    return F.when(value.isNull() | F.is_variant_null(value), nothing).otherwise(
        F.coalesce(
            F.try_variant_get(value, "$", "array<string>"),
            F.array(F.try_variant_get(value, "$", "string")),
        )
    )


def _attempt(value: Column) -> Column:
    """One attempt; what is missing, or not an object at all, is null and so a wrong vote."""
    texts = F.try_variant_get(value, "$.generation", "array<string>")
    text = F.when(texts.isNull(), F.try_variant_get(value, "$.generation", "string"))
    return F.struct(
        F.try_variant_get(value, "$.correct_label", "string").alias("correct_label"),
        F.coalesce(F.get(texts, 0), text).alias("generation"),
    )


def as_attempts(value: Column) -> Column:
    """Attempt array of a cell: an object is one attempt, a non-object entry a wrong vote."""
    entries = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    nothing = F.array().cast("array<struct<correct_label:string,generation:string>>")
    return F.when(value.isNull() | F.is_variant_null(value), nothing).otherwise(
        F.transform(entries, _attempt)
    )


def first_attempt_correct(value: Column) -> Column:
    """Grade of a cell that holds one attempt, or a list whose first entry is graded."""
    entry = F.get(as_attempts(value), 0)
    right = letter(entry["generation"]) == strip(entry["correct_label"])
    return F.coalesce(right.cast("int"), F.lit(0))
