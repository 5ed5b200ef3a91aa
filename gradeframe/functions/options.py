"""Multiple-choice options: display, encoding and reproducible shuffles."""

from pyspark.sql import Column, functions as F

# Fixed value: option letters run from A to X.
MAX_OPTIONS = 24


def option_letter(position: Column) -> Column:
    """Letter of a zero-based position."""
    return F.char(position.cast("int") + 65)


def checked_options(options: Column) -> Column:
    """The option array; more options than letters fail the query."""
    too_many = F.raise_error(F.lit(f"more than {MAX_OPTIONS} options"))
    return F.when(F.size(options) > MAX_OPTIONS, too_many).otherwise(options)


def format_options(options: Column) -> Column:
    """``(A) first`` and so on, one option per line; a null option shows as ``None``."""
    lines = F.transform(
        checked_options(options),
        lambda option, i: F.concat(
            F.lit("("), option_letter(i), F.lit(") "), F.coalesce(option, F.lit("None"))
        ),
    )
    return F.array_join(lines, "\n")


def parse_options(cell: Column) -> Column:
    """Option array of a JSON list cell; null when the cell is not one."""
    return F.from_json(cell, "array<string>")


def encode_options(options: Column) -> Column:
    return F.to_json(options)


def choices_text(options: Column | None, choices: Column | None) -> Column:
    """Formatted options where present, else the ready choices text."""
    found = [c for c in (format_options(options) if options is not None else None, choices) if c is not None]
    if not found:
        raise ValueError("neither an options nor a choices column is given")
    return F.coalesce(*found)


def shuffled_order(count: Column, row_key: Column, attempt: Column, seed: int) -> Column:
    """A permutation of ``0..count-1`` that depends only on seed, row and attempt."""
    positions = F.sequence(F.lit(0), count - 1)
    keyed = F.transform(
        positions,
        lambda i: F.struct(
            F.md5(
                F.concat_ws(
                    "|",
                    F.lit(str(seed)),
                    row_key.cast("string"),
                    attempt.cast("string"),
                    i.cast("string"),
                )
            ).alias("h"),
            i.alias("i"),
        ),
    )
    return F.when(count == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.array_sort(keyed), lambda pair: pair["i"])
    )


def reorder(options: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(options, i))


def remapped_letter(order: Column, answer_index: Column) -> Column:
    """Letter on which the gold option landed; an index outside the options fails the query."""
    place = F.array_position(order, answer_index.cast("int"))
    lost = F.raise_error(F.lit("answer_index is not an option position"))
    return F.when(place == 0, lost).otherwise(option_letter(place - 1))
