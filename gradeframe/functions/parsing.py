"""Column expressions that read answers and decisions out of model text.

All of them are built-in Spark SQL functions, so they stay inside code generation.
The patterns follow Unicode rules for case, white space and word limits.
"""

from pyspark.sql import Column, functions as F

# Fixed values.
SELF_SOLVE = "SELF_SOLVE"
DELEGATE = "DELEGATE"
INVALID = -1
THINK_END = "</think>"
ERROR_PREFIX = "Error"
SPACE = r"[\s\x1c-\x1f]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]"
TAGGED_DECISION = rf"(?iU)<decision>{SPACE}*({SELF_SOLVE}|{DELEGATE})"
BARE_DECISION = rf"(?iU)(?<!{WORD})({SELF_SOLVE}|{DELEGATE})(?!{WORD})"
BOXED = r"(?d)\\boxed\{(.*?)\}"
LONE_CAPITAL = rf"(?<!{WORD})([A-Z])(?!{WORD})"
HASH_MARK = "####"
HASH_ANSWER = rf"(?dU){HASH_MARK}{SPACE}*(.+)"
BOX_MARK = "\\boxed{"
SIZED_BRACKET = rf"(?U)\\left{SPACE}*([(\[])|\\right{SPACE}*([)\]])"
INNER_SPACE = rf"(?U)(?<=\(){SPACE}+|{SPACE}+(?=\))"


def _last_hit(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.trim(text, F.lit(SPACES))


def decision(text: Column) -> Column:
    """1 (solve), 0 (hand off) or -1: the last tagged word, else the last bare word."""
    word = F.coalesce(_last_hit(text, TAGGED_DECISION), _last_hit(text, BARE_DECISION))
    return F.coalesce((F.upper(word) == SELF_SOLVE).cast("int"), F.lit(INVALID))


def after_think(text: Column) -> Column:
    """What follows the last reasoning end tag; the whole text without one."""
    return F.substring_index(text, THINK_END, -1)


def boxed(text: Column) -> Column:
    """Content of the last box up to its first closing brace; null without a box."""
    return _last_hit(after_think(text), BOXED)


def letter(text: Column) -> Column:
    """First stand-alone capital in the last box, or in the text when there is no box."""
    target = F.coalesce(boxed(text), after_think(text))
    return F.nullif(F.regexp_extract(target, LONE_CAPITAL, 1), F.lit(""))


def gsm8k_gold(answer: Column) -> Column:
    """The rest of the line after ``####`` without commas; other text unchanged."""
    tail = F.get(F.regexp_extract_all(answer, F.lit(HASH_ANSWER), 1), 0)
    bare = F.replace(strip(tail), F.lit(","), F.lit(""))
    return F.when(answer.contains(HASH_MARK), F.coalesce(bare, answer)).otherwise(answer)


def math500_gold(answer: Column) -> Column:
    """Sized brackets become plain ones; spaces just inside round brackets go."""
    sized = answer.contains("\\left") | answer.contains("\\right")
    plain = F.when(sized, F.regexp_replace(answer, SIZED_BRACKET, "$1$2")).otherwise(answer)
    return F.regexp_replace(plain, INNER_SPACE, "")


def gold_answer(answer: Column, source: Column | None = None) -> Column:
    """Gold answer by its source tag; without a source column it is left as it is."""
    if source is None:
        return answer
    tag = F.lower(source)
    first = F.when(tag.contains("math500"), math500_gold(answer)).otherwise(answer)
    return F.when(tag.contains("gsm8k"), gsm8k_gold(first)).otherwise(first)


def math_correct(text: Column, gold: Column) -> Column:
    """1 when the box equals the gold answer, both stripped; else 0."""
    return F.coalesce((strip(boxed(text)) == strip(gold)).cast("int"), F.lit(0))


def mcq_correct(text: Column, gold_letter: Column) -> Column:
    """1 when the letter found in the text is the gold letter; else 0."""
    return F.coalesce((letter(text) == strip(gold_letter)).cast("int"), F.lit(0))


def label_word(label: Column) -> Column:
    """Decision word of a 0/1 label; a null label fails the query."""
    return F.when(checked_label(label) == 1, F.lit(SELF_SOLVE)).otherwise(F.lit(DELEGATE))


def checked_label(label: Column) -> Column:
    """The label as INT; a null label fails the query."""
    return F.when(label.isNull(), F.raise_error(F.lit("label is null"))).otherwise(
        label.cast("int")
    )


def reward(text: Column, label: Column) -> Column:
    """+1.0 when the parsed decision equals the label, else -1.0."""
    return F.when(decision(text) == label, F.lit(1.0)).otherwise(F.lit(-1.0))


def is_error(text: Column) -> Column:
    """Whether a stored text is a captured error; false for null."""
    return F.coalesce(text.startswith(ERROR_PREFIX), F.lit(False))
